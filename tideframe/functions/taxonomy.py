"""Group to basket classification."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import col

# Basket names in report order and the groups of each basket.
BASKETS = ["해외지수", "해외섹터", "국내지수", "국내섹터", "FX및 원자재", "국내채권_종합", "국내채권_회사채", "해외채권_종합",
           "해외채권_회사채", "금리연계형 및 초단기채권"]
OTHER = "기타"
BASKET_OF_GROUP = {
    "해외지수": ["US broad equity", "US growth", "Global/Developed equity", "China/HK growth", "China equity", "India/EM", "Japan equity"],
    "해외섹터": ["US semiconductor", "US dividend/defensive", "US cyclical/sector", "US REIT"],
    "국내지수": ["Korea broad equity", "Korea growth"],
    "국내섹터": ["Korea semiconductor", "Korea IT", "Korea cyclical", "Korea value", "Korea defensive"],
    "FX및 원자재": ["FX cash", "Gold", "Commodity/Oil", "Oil"],
    "금리연계형 및 초단기채권": ["Cash/short bonds"],
    "해외채권_회사채": ["US IG bonds", "US high yield"],
    "해외채권_종합": ["US long bonds"],
    "국내채권_종합": ["Korea bonds"],
}
# Bond names that move a fund to another basket than its group's.
CORPORATE_OVERSEAS = "회사채|하이일드|우량회사"
CORPORATE_DOMESTIC = "회사채|금융채"
SHORT_DOMESTIC = "단기|CD|KOFR|머니마켓|통안"


def basket(group, name) -> Column:
    g, n = F.trim(F.coalesce(col(group), F.lit(""))), F.coalesce(col(name), F.lit(""))
    out = (F.when((g == "US long bonds") & n.rlike(CORPORATE_OVERSEAS), "해외채권_회사채")
           .when((g == "Korea bonds") & n.rlike(CORPORATE_DOMESTIC), "국내채권_회사채")
           .when((g == "Korea bonds") & n.rlike(SHORT_DOMESTIC), "금리연계형 및 초단기채권"))
    for b, groups in BASKET_OF_GROUP.items():
        out = out.when(g.isin(groups), b)
    return out.otherwise(OTHER)


def basket_order(b) -> Column:
    """Position in the report order, unknown baskets last."""
    pos = F.array_position(F.array(*[F.lit(x) for x in BASKETS]), col(b))
    return F.when(pos > 0, pos - 1).otherwise(len(BASKETS)).cast("int")
