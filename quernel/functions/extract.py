"""Pattern-based extraction from legal texts (X-20 ... X-32, X-36, X-37)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

UPPER = "A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴ"
_LOWER = UPPER.lower()
_CODE, _COLON, _REST = r"(\d+/\d{4}/[A-Z-]+)", r"\s*:?\s*", r"[^\n]*?"


def _after(*heads: str, flags: str = "iu") -> str:
    """Pattern of one of ``heads`` with an optional colon."""
    return f"(?{flags})(?:{'|'.join(heads)}){_COLON}"


NUMBER = _after("Bản án số", "Quyết định số", "Số") + _CODE
_ROLES = {"judges": ("Thẩm phán", "Chủ tọa"), "prosecutors": ("Kiểm sát viên", "Đại diện VKS"), "defendants": ("Bị cáo", "Bị đơn"), "plaintiffs": ("Nguyên đơn", "Đơn vị khởi tố")}
_KINDS = ("defendants", "plaintiffs", "prosecutors", "judges")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _distinct(values: Column) -> Column:
    """U-03: trimmed, no blanks, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")))


def document_type(text: Column) -> Column:
    """X-20: the most specific of ten kinds by phrases that occur."""
    low = F.lower(text)
    has = lambda s: F.contains(low, F.lit(s))
    judgment = F.when(has("hình sự"), "Bản án hình sự").when(has("dân sự"), "Bản án dân sự").when(has("hành chính"), "Bản án hành chính").otherwise("Bản án")
    decision = F.when(has("thi hành án"), "Quyết định thi hành án").otherwise("Quyết định")
    return F.when(has("bản án"), judgment).when(has("quyết định"), decision).when(has("cáo trạng"), "Cáo trạng").when(has("biên bản"), "Biên bản").otherwise("Văn bản pháp lý")


def case_number(text: Column) -> Column:
    return F.coalesce(_first(text, NUMBER), F.lit(""))


def court_name(text: Column) -> Column:
    return F.trim(F.coalesce(_first(text, r"(?iu)(TÒA ÁN[^\n]*)"), F.lit("")))


def date_issued(text: Column) -> Column:
    return _first(text, _after("Ngày") + "/".join((r"(\d{1,2}", r"\d{1,2}", r"\d{4})")))


def parties(text: Column) -> Column:
    """X-22: per role, what follows it up to a line break or semicolon."""
    found = lambda names: F.transform(_all(text, f"{_after(*names)}({_REST})(?=\n|;)"), lambda v: F.trim(v))
    return F.struct(*(found(_ROLES[k]).alias(k) for k in _KINDS))


_CRIME = ("về tội", "phạm tội")


def charges(text: Column) -> Column:
    """X-23: of more than five characters, each once, sorted."""
    found = _all(text, "(?iu)(?:" + "|".join(_CRIME) + rf""")\s*["']?({_REST})["']?(?=\s*theo|$)""")
    return F.filter(_distinct(found), lambda v: F.length(v) > 5)


def legal_references(text: Column) -> Column:
    """X-24: codes with their year, and articles with clause and point."""
    more = lambda word, what: rf"(?:\s*{word}\s*({what}))?"
    pattern = r"(?iu)điều\s*(\d+)" + more("khoản", r"\d+") + more("điểm", "[a-z]")
    parts = F.arrays_zip(*(_all(text, pattern, k).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))))
    tail = lambda word, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(word), v)).otherwise("")
    articles = F.transform(parts, lambda p: F.concat(F.lit("Điều "), p["a"], tail(" khoản ", p["b"]), tail(" điểm ", p["c"])))
    return _distinct(F.concat(_all(text, r"(?iu)(Bộ luật[^\n]*?\d{4})"), articles))


def verdict(text: Column) -> Column:
    return F.trim(_first(text, _after("Tuyên bố", "Quyết định") + r"([^\n]*)"))


_UNIT, _AMOUNT = "(?:năm|tháng|ngày)", r"(\d+(?:\.\d+)*)"


def sentence(text: Column) -> Column:
    """X-25: prison term and fine, null without either."""
    term = _first(text, rf"(?iu)Phạt\s*{_REST}(\d+\s*{_UNIT}\s*tù)")
    fine = _first(text, "(?iu)" + rf"(?:Phạt tiền|phạt)\s*{_AMOUNT}\s*(?:đồng|VNĐ)")
    return F.nullif(F.concat_ws("; ", term, F.concat(F.lit("Phạt tiền "), fine, F.lit(" đồng"))), F.lit(""))


def key_facts(text: Column) -> Column:
    """X-26: numbered lines of more than 20 characters, at most ten."""
    found = F.transform(_all(text, r"(?m)^\d+\.\s*([^\n]*)"), lambda v: F.trim(v))
    return F.slice(F.filter(found, lambda v: F.length(v) > 20), 1, 10)


def legal_document(text: Column) -> Column:
    """X-20 ... X-26 as one struct."""
    return F.struct(
        document_type(text).alias("document_type"), case_number(text).alias("case_number"), court_name(text).alias("court_name"), date_issued(text).alias("date_issued"),
        parties(text).alias("parties"), charges(text).alias("charges"), verdict(text).alias("verdict"), sentence(text).alias("sentence"),
        legal_references(text).alias("legal_references"), key_facts(text).alias("key_facts"),
    )


def confidence(doc: Column) -> Column:
    """R-25 of a ``legal_document``: weights of what was found, over 10."""
    some = lambda c, w: F.when(F.size(c) > 0, w).otherwise(0.0)
    text = lambda c, w: F.when(F.coalesce(c, F.lit("")) != "", w).otherwise(0.0)
    points = text(doc["case_number"], 2.0) + text(doc["court_name"], 1.5) + text(doc["date_issued"], 1.0) + some(doc["parties"]["defendants"], 1.5)
    points = points + some(doc["parties"]["judges"], 1.0) + some(doc["charges"], 1.5) + some(doc["legal_references"], 1.0) + text(doc["verdict"], 0.5)
    return F.least(F.lit(1.0), points / 10)


def citations(text: Column) -> Column:
    """X-36, second half: six kinds of citation, each once, sorted."""
    year, issue = r"\d{4}", r"\d+/\d{4}"
    dated = ((year, ("Bộ luật", "Luật")), (issue, ("Nghị định", "Thông tư", "Quyết định")))
    more = lambda word, what: rf"(?:\s+{word}\s+{what})?"
    kinds = [r"Điều\s+\d+" + more("khoản", r"\d+") + more("điểm", "[a-z]"), *(f"{name}{_REST}{end}" for end, names in dated for name in names)]
    return F.array_sort(F.array_distinct(F.concat(*(_all(text, f"(?iu)({k})") for k in kinds))))


def key_sections(text: Column) -> Column:
    """X-36, first half: sections with their 0-based positions, by position (regular expressions report no spans, so lengths of what precedes give them)."""
    kinds = {"sentence": "XỬ PHẠT|HÌNH PHẠT", "reasoning": "NHẬN ĐỊNH|XÉT THẤY", "facts": "NỘI DUNG VỤ ÁN|DIỄN BIẾN VỤ ÁN", "charges": "|".join(_CRIME), "verdict": "QUYẾT ĐỊNH|TUYÊN BỐ"}

    def of(kind: str, heads: str) -> Column:
        pattern = rf"(?ius)(?:{heads}).*?(?=\n\n|\n\p{{L}})"

        def spans(z: Column) -> Column:
            found, between = z["found"], z["between"]
            place = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, s: a + F.length(s))
            return F.transform(found, lambda s, i: F.struct(place(i).alias("start_position"), (place(i) + F.length(s)).alias("end_position"), F.lit(kind).alias("type"), F.trim(s).alias("content"), F.length(s).alias("length")))

        return let(F.struct(_all(text, f"({pattern})").alias("found"), F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001").alias("between")), spans)

    return F.array_sort(F.concat(*(of(k, h) for k, h in kinds.items())))


def entities(text: Column) -> Column:
    """X-37: map of kind to distinct values; locations are always empty."""
    name = f"[{UPPER}][{_LOWER}]*"
    kinds = {
        "persons": (rf"(?<![\p{{L}}\p{{N}}_])(?:Ông|Bà|Anh|Chị)\s+({name}(?:\s+{name})*)", 1),
        "organizations": (rf"(?<![\p{{L}}\p{{N}}_])((?:Cơ quan|Công ty|Hội đồng|Tòa án|Viện|Ủy ban)\s+[{UPPER}][^.]*?)(?=\s*[.;,\n])", 1),
        "dates": ("(" + "[/.-]".join((r"\d{1,2}", r"\d{1,2}", r"\d{2,4}")) + ")", 1),
        "amounts": (rf"(?iu)({_AMOUNT}\s*(?:đồng|VNĐ|USD))", 1),
        "case_numbers": (_CODE, 1),
    }
    found = [x for k, (p, g) in kinds.items() for x in (F.lit(k), _distinct(_all(text, p, g)))]
    return F.create_map(*found, F.lit("locations"), F.array().cast("array<string>"))


def normalise_entity(name: Column) -> Column:
    """X-27: lower case, single spaces, without one leading honorific."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.trim(F.regexp_replace(plain, r"^(?:ông|bà|anh|chị)\s+", ""))


def law_reference(name: Column) -> Column:
    """X-29: law name and article number."""
    return F.struct(_first(name, r"(?iu)(Bộ luật[^\n,;]*|Luật[^\n,;]*)").alias("law_name"), _first(name, r"(?iu)Điều\s+(\d+)").alias("article_number"))


STOP_WORDS = ("các", "cho", "có", "của", "là", "một", "những", "này", "trong", "và", "được")


def keywords(text: Column, most: int = 50, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """X-30: words of three letters or more that aren't stop words, most frequent first, then by name."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{3,})"), 1), lambda w: ~w.isin(*stop))

    def ranked(words: Column) -> Column:
        """Of sorted words: where each run of equal ones begins, and from that how long it is."""
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        runs = let(starts, lambda at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(words))).alias("n"), F.get(words, i).alias("w"))))
        return F.when(F.size(words) > 0, F.slice(F.transform(F.array_sort(runs), lambda r: r["w"]), 1, most)).otherwise(F.array().cast("array<string>"))

    return let(F.array_sort(found), ranked)


def parse_date(text: Column) -> Column:
    """X-31: d/m/Y, Y-m-d or d-m-Y; null for anything else."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy")))
