import pytest

from folio.operators import strict as S

SOURCE = "Revenue was ₹285.97 million in 2023. The cash flow was (1,234.50) and tax was 55.5. We had a net loss of Rs. 640 lakh. The sum of 812 does not include the 99.5 paid."


@pytest.mark.parametrize(("rewrite", "found"), [
    ("Revenue was ₹285.97 million.", []), ("Revenue was 285.97.", [("unit_dropped", "285.97 (source: ₹285.97 million)")]), ("Revenue was 285.97 million, and 640 was lost.", [("unit_dropped", "640 (source: Rs. 640 lakh)")]), ("It runs 2 plants since 2023.", []),
    ("Cash flow was negative at 1,234.50.", []), ("The tax of 55.5 was negative.", [("sign_flip", "55.5 called negative: The tax of 55.5 was negative.")]), ("In 2023 it was negative. It had 812 plants.", []), ("It was negative: ₹640 lakh.", []),
    ("The 99.5 paid is included in it.", [("inclusion_polarity", "The 99.5 paid is included in it.")]), ("The 99.5 is not included.", []), ("It is part of 55.5.", []), ("", []), (None, []),
])
def test_findings(spark, rewrite, found):
    df = spark.createDataFrame([(1, SOURCE, rewrite)], "k int, o string, s string")
    assert [(r["reason"], r["detail"]) for r in S.strict_findings(df, "k", "o", "s").collect()] == found
