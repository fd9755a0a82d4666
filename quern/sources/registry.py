"""Names of public datasets by the shape that reads them, and the defaults of a run."""

from __future__ import annotations

MAX_QUERIES = 100
DEFAULT_METHOD = "dense"
DEFAULT_K = 100

#: name -> (shape in quern.sources.shapes, parameters). Raw frames come from wherever the data is kept.
ORIGINAL = {
    "fiqa": ("three_tables", {"semi_join_queries": True}), "bioasq": ("paired_rows", {"query_prefix": "q_", "document_prefix": "d_"}), "stackoverflowqa": ("zipped_rows", {}),
    "qmsum": ("paired_rows", {}), "msmarco": ("parallel_arrays", {}), "finqabench": ("paired_rows", {"query": "Query", "document": "Context"}), "financebench": ("list_or_scalar", {}),
    "mbpp": ("array_rows", {}), "curev1": ("three_tables", {"agreeing": True}), "ineqs": ("paired_rows", {"ident": "data_id"}), "cosqa": ("three_tables", {"semi_join_queries": True}),
    "legalquad": ("three_tables", {}), "lecardv2": ("three_tables", {}), "legalsum": ("three_tables", {}), "aila": ("three_tables", {}), "consumercontracts": ("three_tables", {}), "corporatelobbying": ("three_tables", {}),
}
NEW = {
    **{f"leetcode_{lang}": ("picked_column", {"column": lang}) for lang in ("python", "java", "javascript", "c++")},
    "enronqa": ("mails", {}), "quora": ("sampled_pairs", {"n": 10_000}), "quora_swedish": ("paired_rows", {}), "meeting": ("paired_rows", {"query_prefix": "q", "document_prefix": "d"}),
    "narrativeqa": ("first_pairs", {"n": 1000}), "pandas": ("paired_rows", {}),
}
#: Shapes of dataset families that are parameterised by task.
FAMILIES = {"multi_split_maps": "combined_splits", "instructed": "instructed", "zipped_corpora": "corpus_lines"}
VECTOR_WIDTHS = {"large": 3072, "small": 1536, "medium": 1024}
VECTORS_PER_BATCH = (96, 2048)
TOKENS_PER_BATCH = (50_000, 1_000_000)


def datasets(which: str = "original") -> dict[str, tuple[str, dict]]:
    if which not in ("original", "new", "all"):
        raise KeyError(which)
    return {**(NEW if which != "original" else {}), **(ORIGINAL if which != "new" else {})}


def vector_width(model: str) -> int:
    if model not in VECTOR_WIDTHS:
        raise KeyError(f"no vector width is known for {model}")
    return VECTOR_WIDTHS[model]
