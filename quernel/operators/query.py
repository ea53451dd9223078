"""Query rewriting and task analysis (X-46 ... X-52, K-11, Z-11). Dictionaries are small and live on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP = frozenset("a an and are as at be by for from in is it of on or that the this to was with và của các có là những trong cho được".split())
SYNONYMS = {"contract": ["agreement", "deal"], "law": ["statute", "act"], "court": ["tribunal"], "crime": ["offence"], "judge": ["magistrate"]}
DOMAIN = {"court": ["judgment", "hearing"], "contract": ["clause", "party"], "criminal": ["sentence"], "civil": ["dispute"]}
SHORT = {"blds": "bộ luật dân sự", "blhs": "bộ luật hình sự", "tand": "tòa án nhân dân", "ubnd": "ủy ban nhân dân", "hđ": "hợp đồng"}
WEIGHTS = {"synonym": 0.8, "semantic": 0.7, "statistical": 0.6, "domain": 0.9, "abbreviation": 0.95}
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", **{f"'{k}": f" {v}" for k, v in (("m", "am"), ("ve", "have"), ("ll", "will"), ("re", "are"))}}
TASKS = {
    "document_analysis": ["analyze", "analysis", "review", "examine", "phân tích"], "legal_research": ["research", "precedent", "find law", "law", "nghiên cứu"],
    "contract_review": ["contract", "agreement", "hợp đồng"], "compliance_check": ["compliant", "compliance", "regulation", "tuân thủ"], "case_summary": ["summarize", "summary", "tóm tắt"],
}
JURISDICTIONS = {"vietnam": ["vietnam", "vietnamese", "việt nam"], "us": ["united states", "federal", "american"], "eu": ["european union", "gdpr"]}
URGENT = ("urgent", "asap", "immediately", "khẩn cấp")


def preprocess(text: str, stem: bool = False) -> list[str]:
    """X-46: contractions out, lower case, punctuation as spaces, words of 2 to 50 characters that aren't stop words."""
    low = text.lower()
    for k, v in CONTRACTIONS.items():
        low = low.replace(k, v)
    found = [w for w in re.sub(r"[^\w\s]", " ", low).split() if 2 <= len(w) <= 50 and w not in STOP]
    return [re.sub(r"(ing|ed|es|s)$", "", w) if stem and len(w) > 4 else w for w in found]


def expand(tokens: list[str], cooccurring: dict[str, list[str]] | None = None) -> list[tuple[str, str, float]]:
    """X-47: (term, kind, weight), heaviest first, each term once, at most three a token."""
    tables = {"synonym": SYNONYMS, "domain": DOMAIN, "abbreviation": {k: [v] for k, v in SHORT.items()}, "statistical": cooccurring or {}}
    best: dict[str, tuple[str, float]] = {}
    for t in tokens:
        for kind, words in tables.items():
            for w in words.get(t, ()):
                if w not in tokens and WEIGHTS[kind] > best.get(w, ("", 0.0))[1]:
                    best[w] = (kind, WEIGHTS[kind])
    ranked = sorted(((w, k, x) for w, (k, x) in best.items()), key=lambda r: (-r[2], r[0]))
    return ranked[: 3 * len(tokens)]


def confidence(expansions: list[tuple[str, str, float]]) -> float:
    return sum(w for *_, w in expansions) / len(expansions) if expansions else 0.0


def final_terms(tokens: list[str], expansions: list[tuple[str, str, float]], least: float = 0.7) -> list[str]:
    """X-48."""
    return sorted({*tokens, *(t for t, _, w in expansions if w >= least)})


def variants(text: str, legal: bool = False, most: int = 5) -> list[str]:
    """X-49: the query, then itself with one word replaced by a synonym, then in legal contexts; at most ``most`` of each, in order."""
    words = text.lower().split()
    swapped = [text.lower().replace(w, s) for w in words for s in SYNONYMS.get(w, ())][:most]
    context = [f"{text} {c}" for c in ("law", "regulation", "judgment", "statute")][:most] if legal else []
    return list(dict.fromkeys([text, *swapped, *context]))


def cooccurring(docs: DataFrame, term: str, body: str = "text", most: int = 5) -> DataFrame:
    """K-09: the words that most documents with ``term`` share."""
    from ..functions.text import tokens

    toks = docs.select(F.array_distinct(tokens(F.col(body))).alias("t")).where(F.array_contains("t", term))
    return toks.select(F.explode("t").alias("term")).where(F.col("term") != term).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(most)


def _best(text: Column, tables: dict[str, list[str]], default: str) -> Column:
    """The first kind of most keyword hits (substrings); the default without any."""
    low = F.lower(text)
    counts = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in tables.items()}
    most = F.greatest(*counts.values())
    out = F.lit(default)
    for k, n in reversed(counts.items()):
        out = F.when(n == most, k).otherwise(out)
    return F.when(most == 0, default).otherwise(out)


def analyse(text: Column) -> Column:
    """X-50: task, jurisdiction (Vietnam unless another is named) and urgency."""
    low = F.lower(text)
    urgent = sum((F.contains(low, F.lit(w)).cast("int") for w in URGENT), F.lit(0)) > 0
    return F.struct(_best(text, TASKS, "legal_research").alias("task"), _best(text, JURISDICTIONS, "vietnam").alias("jurisdiction"), F.when(urgent, "high").otherwise("normal").alias("urgency"))


def strategy(task: Column, has_documents: Column, long_history: Column) -> Column:
    """X-51."""
    return F.when(has_documents & long_history, "hybrid").when(has_documents, "context_aware").when(task == "legal_research", "research").otherwise("template_based")


def mine_answer(text: Column) -> Column:
    """X-52: bracketed citations, and lines that recommend or warn (five and three at most)."""
    lines = F.split(text, "\n")
    pick = lambda p, n: F.slice(F.filter(lines, lambda s: s.rlike(p)), 1, n)
    return F.struct(F.slice(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), 1), 1, 5).alias("citations"), pick("(?iu)recommend|should|khuyến nghị|nên", 5).alias("recommendations"), pick("(?iu)risk|warning|rủi ro", 3).alias("risks"))


def suggest(known: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """K-11: known queries (pos, query) that have the text in them, in list order."""
    return known.where(F.contains(F.lower("query"), F.lit(text.lower()))).orderBy("pos").limit(limit)
