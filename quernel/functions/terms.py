"""Dictionary of legal terms by category (A-24), counted as whole words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import whole_word_count


def _of(line: str) -> list[str]:
    return [t.strip() for t in line.split("|")]


TERMS = {
    "court_terms": _of("bị cáo|bị đơn|hội thẩm|kiểm sát viên|luật sư|nguyên đơn|người bào chữa|người bảo vệ quyền lợi|thẩm phán|tòa án"),
    "procedure_terms": _of("biên bản|bản án|giám đốc thẩm|kháng cáo|phiên tòa|quyết định|truy tố|tái thẩm|tố tụng|xét xử|điều tra"),
    "criminal_terms": _of("cải tạo không giam giữ|hình phạt|phạt tiền|tình tiết giảm nhẹ|tình tiết tăng nặng|tái phạm|tù giam|tịch thu|tội phạm|đồng phạm"),
    "civil_terms": _of("bồi thường|hôn nhân gia đình|hợp đồng|nghĩa vụ|quyền sở hữu|thiệt hại|thừa kế|tranh chấp|tài sản"),
    "legal_references": _of("bộ luật|chương|chỉ thị|khoản|luật|mục|nghị định|phần|quyết định|thông tư|điều|điểm"),
}


def counts(text: Column) -> Column:
    """Category -> term -> occurrences, terms that occur only. A term in two categories counts in each."""
    def of(terms: list[str]) -> Column:
        found = F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*(whole_word_count(text, t) for t in terms)))
        return F.map_filter(found, lambda _, n: n > 0)

    return F.create_map(*(x for c, terms in TERMS.items() for x in (F.lit(c), of(terms))))


def hits(text: Column) -> Column:
    """All occurrences over all categories."""
    return sum((whole_word_count(text, t) for terms in TERMS.values() for t in terms), F.lit(0))
