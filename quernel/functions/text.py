"""Text expressions: tokens, sentences, scores, structure. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """``body`` of a column that stands for ``value``, which is so computed once, however often ``body`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_DIACRITICS = "àáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"


def tokens(text: Column) -> Column:
    """X-01 ranking tokens: lower case, non-word characters as spaces, longer than one character."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) > 1)


def words(text: Column) -> Column:
    """X-02 words: runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), 1)


def split_words(text: Column) -> Column:
    """White-space words; none for blank text."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def sentences(text: Column) -> Column:
    """X-03: cut after . ! or ? and white space; trimmed, blanks dropped (rule-based stand-in for a trained splitter)."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(values).cast("double"))


def coherence(parts: Column) -> Column:
    """X-04: 1 - variance / (mean^2 + 1) of words a sentence, within 0 and 1; 1 for one sentence or none."""
    # One pass for number, sum and sum of squares: a lambda that names the mean would compute it for each sentence.
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    score = F.aggregate(
        F.transform(parts, lambda s: F.regexp_count(s, F.lit(r"\S+")).cast("double")), start,
        lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.lit(1.0) - (a["q"] / a["n"] - F.pow(a["s"] / a["n"], F.lit(2.0))) / (F.pow(a["s"] / a["n"], F.lit(2.0)) + 1),
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(F.size(parts) <= 1, F.lit(1.0)).otherwise(score)


def completeness(text: Column, parts: Column) -> Column:
    """X-05: share of sentences that end in . ! ? : or ;, and 0.1 more if the text begins with a capital; at most 1."""
    ended = F.size(F.filter(parts, lambda s: s.rlike("[.!?:;]$"))).cast("double")
    share = F.when(F.size(parts) > 0, ended / F.size(parts)).otherwise(F.lit(0.0))
    bonus = F.when(F.trim(text).rlike(r"^\p{Lu}"), 0.1).otherwise(0.0)
    return F.when(F.trim(text) == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), share + bonus))


def language(text: Column) -> Column:
    """X-40: 'vi' if any letter of the Vietnamese accent set occurs, else 'en'."""
    return F.when(F.lower(text).rlike(f"[{_DIACRITICS}]"), "vi").otherwise("en")


def length_score(text: Column) -> Column:
    """R-04."""
    n = F.length(text).cast("double")
    return F.when((n >= 100) & (n <= 1000), 1.0).when(n < 100, n / 100).otherwise(F.greatest(F.lit(0.3), F.lit(1000.0) / n))


def quality(text: Column, title: Column | None = None, author: Column | None = None, newline_bonus: bool = True) -> Column:
    """X-38 filter quality."""
    n = F.length(text)
    has = lambda c: F.lit(0.0) if c is None else F.when(F.coalesce(c, F.lit("")) != "", 0.1).otherwise(0.0)
    score = F.lit(0.5) + F.when(n.between(50, 2000), 0.2).when(n < 50, -0.2).otherwise(0.0)
    score = score + F.when(F.contains(text, F.lit(".")), 0.1).otherwise(0.0) + has(title) + has(author)
    if newline_bonus:
        score = score + F.when(text.rlike(r"[\n\t]"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def content_quality(text: Column, title: Column | None = None, author: Column | None = None) -> Column:
    """R-08 ranking quality."""
    both = F.lit(0.0) if title is None or author is None else F.when((F.coalesce(title, F.lit("")) != "") & (F.coalesce(author, F.lit("")) != ""), 0.1).otherwise(0.0)
    score = F.lit(0.5) + F.when(F.length(text).between(50, 2000), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(F.contains(text, F.lit(".")), 0.1).otherwise(0.0) + F.when(text.rlike(r"[\n\t]"), 0.1).otherwise(0.0) + both)


def summary(text: Column, most: int = 500) -> Column:
    """X-41."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """X-54: four characters a token."""
    return F.floor(F.length(text) / 4).cast("long")


def whole_word_count(text: Column, term: str) -> Column:
    """Occurrences of ``term`` not touching another word character, case folded."""
    import re

    return F.regexp_count(F.lower(text), F.lit(rf"(?<!{WORD}){re.escape(term)}(?!{WORD})"))


def complexity(text: Column, legal: Column | None = None) -> Column:
    """X-34: struct of average lengths, densities and totals; ``legal``: number of term hits (default: ``terms.hits``)."""
    from . import terms

    found = words(text)
    n = F.size(found).cast("double")
    cut = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")).cast("double")
    chars = F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w)).cast("double")
    hits = terms.hits(text) if legal is None else legal
    cited = sum((F.regexp_count(text, F.lit(p)) for p in (r"(?iu)điều\s+\d+", r"(?iu)khoản\s+\d+", r"(?iu)điểm\s+[a-z]")), F.lit(0)).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(
        zero(F.try_divide(n, cut)).alias("average_sentence_length"),
        zero(F.try_divide(chars, n)).alias("average_word_length"),
        zero(F.try_divide(hits.cast("double"), n)).alias("legal_term_density"),
        zero(F.try_divide(cited, n) * 100).alias("citation_density"),
        n.cast("long").alias("total_words"), cut.cast("long").alias("total_sentences"), F.length(text).cast("long").alias("total_characters"),
    )


def readability(metrics: Column) -> Column:
    """X-35 of a ``complexity`` struct: 0 to 100."""
    one = F.lit(1.0)
    load = F.least(metrics["average_sentence_length"] / 20, one) + F.least(metrics["average_word_length"] / 8, one) + F.least(metrics["legal_term_density"] * 10, one)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (one - load / 3) * 100))


def structure(text: Column) -> Column:
    """X-33: line and section counts, the level of the last numbered line, and whether articles, clauses or points are cited."""
    lines = F.split(text, "\n")
    level = lambda s: F.when(s.rlike(r"^[IVX]+\.\s*.+$"), 1).when(s.rlike(r"^\d+\.\s*.+$"), 2).when(s.rlike(r"^[a-z]\)\s*.+$"), 3).otherwise(0)
    levels = F.filter(F.transform(lines, lambda s: level(F.trim(s))), lambda k: k > 0)
    of = lambda k: F.size(F.filter(levels, lambda x: x == k)).cast("long")
    return F.struct(
        F.size(lines).cast("long").alias("total_lines"), of(1).alias("roman"), of(2).alias("numbered"), of(3).alias("lettered"),
        F.coalesce(F.try_element_at(levels, F.lit(-1)), F.lit(0)).cast("long").alias("hierarchy_depth"),
        text.rlike(r"(?iu)điều\s+\d+|khoản\s+\d+|điểm\s+[a-z]").alias("has_legal_citations"),
    )


def is_scanned(pages: Column, images: Column) -> Column:
    """X-42: under 50 characters of stripped text on all pages, and an image."""
    return (F.aggregate(pages, F.lit(0), lambda a, p: a + F.length(F.trim(F.coalesce(p, F.lit(""))))) < 50) & (images > 0)


def layout_type(tables: Column, blocks: Column, header: Column, footer: Column) -> Column:
    """X-43."""
    return F.when(tables > 3, "table_heavy").when((tables > 0) & (blocks > 10), "mixed").when(header & footer & (blocks > 5), "formal").otherwise("text")
