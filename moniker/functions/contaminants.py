"""Example forms that a model copies from its prompt for names that they don't belong to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip_marks

# Labels and the forms that are right for them only; forms right for labels with certain words only.
EXAMPLES = (
    (("guillaume j. filion", "guillaume filion"), ("纪尧姆·菲利翁", "ギヨーム・フィリオン", "기욤 필리옹")),
    (("fatima al-hassan", "fatima al hassan"), ("法蒂玛·哈桑", "ファティマ・アル＝ハッサン", "파티마 알-핫산")),
    (("josé maría garcía-lópez", "jose maria garcia-lopez"), ("何塞·玛丽亚·加西亚-洛佩斯", "ホセ・マリア・ガルシア＝ロペス")),
    (("zhang wei", "wei zhang", "wei chang", "chang wei"), ("张伟", "チョウ・ウェイ", "チャン・ウェイ", "장 웨이")),
)
ORPHANS = (("tanaka", "yuki"), ("田中雪", "タナカ ユキ", "다나카 유키"))


def label_key(label: Column) -> Column:
    """What labels are compared by: lower case without accents."""
    return F.lower(strip_marks(label))


def holds_example(key: Column, value: Column, examples=EXAMPLES, orphans=ORPHANS) -> Column:
    """``value`` holds an example form that is not for the label with this key."""
    has = lambda forms: F.exists(F.array(*map(F.lit, forms)), lambda f: value.contains(f))
    found = F.lit(False)
    for labels, forms in examples:
        found = found | (~key.isin(*labels) & has(forms))
    words, forms = orphans
    return found | (~F.exists(F.array(*map(F.lit, words)), lambda w: key.contains(w)) & has(forms))


def is_contaminant(label: Column, value: Column, examples=EXAMPLES, orphans=ORPHANS) -> Column:
    return holds_example(label_key(label), value, examples, orphans)
