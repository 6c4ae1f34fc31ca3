"""Which category each metric belongs to, which metrics factor analysis leaves out, and the selection of features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Categories and their metrics, in the order in which features are laid out.
CATEGORIES = {
    "Lexical Richness": [
        "n_unique_tokens", "proportion_unique_tokens", "mattr", "oov_ratio", "alpha_ratio",
    ],
    "Word Form Complexity": [
        "mean_word_length", "token_length_mean", "token_length_median", "token_length_std", "syllables_per_token_mean",
        "syllables_per_token_median", "syllables_per_token_std",
    ],
    "Document Scale": [
        "doc_length", "n_tokens", "n_characters", "n_sentences", "sentence_length_mean", "sentence_length_median", "sentence_length_std",
    ],
    "Repetition": [
        "duplicate_line_chr_fraction", "duplicate_paragraph_chr_fraction", "duplicate_ngram_chr_fraction_5",
        "duplicate_ngram_chr_fraction_6", "duplicate_ngram_chr_fraction_7", "duplicate_ngram_chr_fraction_8",
        "duplicate_ngram_chr_fraction_9", "duplicate_ngram_chr_fraction_10", "top_ngram_chr_fraction_2", "top_ngram_chr_fraction_3",
        "top_ngram_chr_fraction_4",
    ],
    "POS Distribution": [
        "pos_prop_ADJ", "pos_prop_ADP", "pos_prop_ADV", "pos_prop_AUX", "pos_prop_CCONJ", "pos_prop_DET", "pos_prop_INTJ",
        "pos_prop_NOUN", "pos_prop_NUM", "pos_prop_PART", "pos_prop_PRON", "pos_prop_PROPN", "pos_prop_PUNCT", "pos_prop_SCONJ",
        "pos_prop_SYM", "pos_prop_VERB", "pos_prop_X",
    ],
    "Syntax": [
        "dependency_distance_mean", "dependency_distance_std", "prop_adjacent_dependency_relation_mean",
        "prop_adjacent_dependency_relation_std",
    ],
    "Readability": [
        "flesch_reading_ease", "flesch_kincaid_grade", "smog", "gunning_fog", "automated_readability_index", "coleman_liau_index", "lix",
        "rix",
    ],
    "LM Entropy": [
        "H_unigram_win_mean_nats", "H_unigram_win_std_nats", "PPL_unigram_win_mean", "H_3gram_self_nats", "PPL_3gram_self_nats",
    ],
    "Coherence & Trajectory": [
        "first_order_coherence", "second_order_coherence", "semantic_drift_start_end", "cumulative_semantic_trajectory_length",
        "semantic_trajectory_length_per_word", "segment_transition_variability", "semantic_range_max_dist",
    ],
    "On-topic vs. Dispersion": [
        "on_topic_consistency", "semantic_dispersion", "semantic_concentration",
    ],
    "Topic Strength & Volume": [
        "pc1_topic_strength", "pc_top5_strength", "semantic_volume_logdet",
    ],
    "Clustering & Diversity": [
        "kmeans_k", "topic_cluster_entropy", "topic_diversity_effective_k", "max_cluster_share", "cluster_focus_norm",
    ],
    "Book Size / Shape": [
        "n_chunks", "embedding_dim",
    ],
    "Affect Dimensions": [
        "vad_valence_mean", "vad_valence_std", "vad_arousal_mean", "vad_arousal_std", "vad_dominance_mean", "vad_dominance_std",
    ],
    "Discrete Emotions": [
        "emo_anger", "emo_anticipation", "emo_disgust", "emo_fear", "emo_joy", "emo_sadness", "emo_surprise", "emo_trust",
        "emo_diversity",
    ],
    "Concreteness & Imagery": [
        "concreteness_mean", "concreteness_std",
    ],
    "Lexical Register": [
        "aoa_mean", "aoa_std", "prevalence_mean",
    ],
    "Punctuation Style": [
        "comma_rate", "semicolon_rate", "colon_rate", "dash_rate", "exclamation_rate", "question_rate", "parenthesis_rate",
        "quotation_rate", "ellipsis_rate",
    ],
    "Syntactic Complexity": [
        "subordination_ratio", "coordination_ratio", "clauses_per_sentence", "parse_tree_depth_mean", "parse_tree_depth_std",
        "mean_dependents_per_head", "prop_complex_sentences",
    ],
}

# Metrics that repeat others, sum to one with others, or measure size; left out of factor analysis.
LEFT_OUT = [
    "n_unique_tokens", "proportion_unique_tokens", "alpha_ratio", "token_length_mean", "token_length_median", "token_length_std",
    "syllables_per_token_median", "doc_length", "n_characters", "n_sentences", "sentence_length_median", "sentence_length_std",
    "duplicate_line_chr_fraction", "duplicate_paragraph_chr_fraction", "duplicate_ngram_chr_fraction_5",
    "duplicate_ngram_chr_fraction_6", "duplicate_ngram_chr_fraction_7", "duplicate_ngram_chr_fraction_9",
    "duplicate_ngram_chr_fraction_10", "top_ngram_chr_fraction_3", "top_ngram_chr_fraction_4", "pos_prop_X",
    "automated_readability_index", "coleman_liau_index", "flesch_kincaid_grade", "flesch_reading_ease", "lix", "rix", "smog",
    "PPL_unigram_win_mean", "PPL_3gram_self_nats", "second_order_coherence", "cumulative_semantic_trajectory_length",
    "on_topic_consistency", "semantic_concentration", "kmeans_k", "topic_diversity_effective_k", "cluster_focus_norm", "n_chunks",
    "embedding_dim",
]

CATEGORY = {m: c for c, names in CATEGORIES.items() for m in names}


def select_features(columns: Iterable[str], leave_out: Iterable[str] = ()) -> dict[str, str]:
    """Category of each known metric among `columns`, in the order above, without those to leave out.

    Columns that are no metrics are passed over; a name to leave out that is no metric is an error."""
    present, out = set(columns), set(leave_out)
    if odd := sorted(out.difference(CATEGORY)):
        raise ValueError(f"no metrics of this taxonomy: {', '.join(odd)}")
    return {m: c for m, c in CATEGORY.items() if m in present - out}


def features(df: DataFrame, keys: list[str], leave_out: Iterable[str] = LEFT_OUT) -> DataFrame:
    """The key columns and the selected metrics, so that a scan reads no others."""
    return df.select(*keys, *select_features(df.columns, leave_out))


def table(spark: SparkSession) -> DataFrame:
    """metric, category, left_out, position."""
    return spark.createDataFrame([(m, c, m in LEFT_OUT, i) for i, (m, c) in enumerate(CATEGORY.items())], "metric string, category string, left_out boolean, position int")
