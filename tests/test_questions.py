"""The parser of questions: worked cases."""

from corpusloom.operators import questions as qs

CASES = [
    # text, speaker, year, from, to, term, other term, kinds, query
    ("김성수 의원이 발언한 무선국 내용을 찾아줘", "김성수", None, None, None, None, None, [], "무선국"),
    ("최근 5년간 주파수 재할당 관련 발언", None, None, 2022, 2026, None, None, [], "주파수 재할당"),
    ("지난 40년간 주파수 정책 논의", None, None, None, None, None, None, [], "주파수 정책"),
    ("2019~2021년 도매대가 국감", None, None, 2019, 2021, None, None, ["국정감사"], "도매대가"),
    ("21년부터 19년까지 알뜰폰을 알려줘", None, None, 2019, 2021, None, None, [], "알뜰폰"),
    ("19년 상임위에서 언급된 통신비 인하", None, 2019, None, None, None, None, ["상임위"], "통신비 인하"),
    ("1900MHz 대역에서 간섭", None, None, None, None, None, None, [], "1900MHz 대역"),
    ("2009년 위성 통신 기술 정책", None, None, None, None, None, None, [], "2009년 위성"),
    ("22대 국회에서 5G 품질", None, None, None, None, 22, None, [], "5G 품질"),
    ("제19대 국회 번호이동", None, None, None, None, None, 19, [], "번호이동"),
    ("망 중립성에 대해 의원들이 뭐라고 했는지", None, None, None, None, None, None, [], "중립성"),
    ("김성수 무선국", "김성수", None, None, None, None, None, [], "무선국"),
    ("국가 평가", "국가", None, None, None, None, None, [], "평가"),
    ("방송통신위원회에서 의원님들이 언급한 전파 정책은", None, None, None, None, None, None, [], "전파 정책"),
    ("", None, None, None, None, None, None, [], ""),
]


def test_questions(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "id int, q string")
    got = {r["id"]: tuple(r)[1:] for r in qs.parsed_questions(df, "q", 2016, 2026).collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case, case[0]
    assert got[99][1:7] == (None,) * 6
