"""Question routing by rules, and heuristic query rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Vocabularies.
CALCULATION_TERMS = "average change decline decrease difference growth increase percentage ratio total".split()
TABLE_TERMS = "amount balance cash cost expense income liability margin million net percent rate revenue sales shares tax transaction volume".split()
OUT_OF_SCOPE = ["breaking news", "current stock price", "real time", "right now", "stock price today", "weather"]
ARITHMETIC = r"(?d)\b(divided by|minus|plus|per|from .+ to|between .+ and)\b"

REASONS = {
    "out_of_scope": "Question appears to need information outside the indexed reports.",
    "calculation": "Numeric or table-like question; use dense retrieval plus neighbors for calculation context.",
    "exact_term": "Question contains exact terms or dates; combine dense and lexical retrieval.",
    "default": "Default report question route; dense retrieval is the strongest current baseline.",
    "explicit": "Explicit retrieval settings were provided.",
}

TOP_K, CANDIDATE_K = 10, 30


def has_year(q: Column) -> Column:
    return q.rlike(T.YEAR)


def has_number(q: Column) -> Column:
    return q.rlike(r"(?U)\d")


def has_quoted_phrase(q: Column) -> Column:
    return q.rlike(r"""(?d)['"].+['"]""")


def has_ticker(q: Column) -> Column:
    return q.rlike(r"\b[A-Z]{2,5}\b")


def has_arithmetic(q: Column) -> Column:
    return F.lower(q).rlike(ARITHMETIC)


def has_word(q: Column, words: list[str]) -> Column:
    return F.arrays_overlap(T.find_all(F.lower(q), "[a-z]+"), T.texts(words))


def signals(q: Column) -> Column:
    """Ordered list of the signals of a question; null and empty questions have none."""
    low = F.lower(q)
    found = F.array_compact(
        F.array(
            F.when(T.contains_any(low, OUT_OF_SCOPE), "out_of_scope"),
            F.when(has_word(q, CALCULATION_TERMS) | has_arithmetic(q), "calculation"),
            F.when(has_word(q, TABLE_TERMS), "table_metric"),
            F.when(has_year(q) | has_quoted_phrase(q) | has_ticker(q), "exact_term"),
            F.when(has_number(q), "number"),
        )
    )
    return F.coalesce(found, F.array().cast("array<string>"))


def route(q: Column, candidate_k: Column | int = 0) -> Column:
    """struct(related, method, top_k, candidate_k, window, reason, signals); the first rule that fits."""
    s = signals(q)
    wide = F.greatest(F.coalesce(F.lit(candidate_k) if isinstance(candidate_k, int) else candidate_k, F.lit(0)), F.lit(CANDIDATE_K))
    has = lambda name: F.array_contains(s, name)

    def of(related: bool, method: str, window: int, reason: str) -> Column:
        return F.struct(
            F.lit(related).alias("related"), F.lit(method).alias("method"), F.lit(TOP_K if related else 0).alias("top_k"), (wide if related else F.lit(0)).cast("int").alias("candidate_k"),
            F.lit(window).alias("window"), F.lit(reason).alias("reason"), s.alias("signals"),
        )

    return (
        F.when(has("out_of_scope"), of(False, "dense", 0, REASONS["out_of_scope"]))
        .when(has("calculation") | has("table_metric"), of(True, "dense", 1, REASONS["calculation"]))
        .when(has("exact_term"), of(True, "hybrid", 0, REASONS["exact_term"]))
        .otherwise(of(True, "dense", 0, REASONS["default"]))
    )


def explicit_route(method: str, top_k: int, candidate_k: int, window: int) -> Column:
    """The route of given settings; these never abstain."""
    if method not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown retrieval method: {method}")
    return F.struct(
        F.lit(True).alias("related"), F.lit(method).alias("method"), F.lit(top_k).alias("top_k"), F.lit(max(candidate_k, top_k)).alias("candidate_k"), F.lit(window).alias("window"),
        F.lit(REASONS["explicit"]).alias("reason"), F.array().cast("array<string>").alias("signals"),
    )


def resolve(q: Column, method: str, top_k: int = 5, candidate_k: int = 10, window: int = 0) -> Column:
    return route(q, candidate_k) if method == "adaptive" else explicit_route(method, top_k, candidate_k, window)


def rewrite(q: Column) -> Column:
    """Quoted phrases, years, numbers and terms of a question, each once; the question itself if there are none."""
    stop = T.texts(T.REWRITE_STOPWORDS)
    terms = T.find_all(F.lower(q), T.REWRITE_TERM)
    # stopwords are told by the term as found, its length by the term without points and dashes at the ends
    terms = F.filter(terms, lambda t: ~F.array_contains(stop, t))
    terms = F.filter(F.transform(terms, lambda t: F.regexp_replace(t, r"^[.-]+|[.-]+$", "")), lambda t: F.length(t) > 2)
    items = T.first_by_lower(F.concat(T.quoted_phrases(q), T.years(q), T.number_mentions(q), terms))
    return F.when(F.size(items) > 0, F.array_join(items, " ")).otherwise(T.strip(q))
