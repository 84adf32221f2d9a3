"""References in answers and notices: worked cases."""

import pytest

from corpusloom.functions import references as rf
from corpusloom.operators import citations as ct

NAMES = rf.Names(
    ["전기통신사업법", "전기통신사업법 시행령", "방송통신사업 금지행위 등에 대한 업무처리규정", "전파법", "정보통신망 이용촉진 및 정보보호 등에 관한 법률", "갑 업무처리기준", "을 업무처리기준"],
    {"정보통신망법": "정보통신망 이용촉진 및 정보보호 등에 관한 법률"},
)
TB, DECREE, RADIO, RULES = "전기통신사업법", "전기통신사업법 시행령", "전파법", "방송통신사업 금지행위 등에 대한 업무처리규정"


@pytest.mark.parametrize(
    "text,want",
    [
        ("제50조(금지행위) 제1항 제5호·5호의2: 대리점", [(None, "none", "50조", "금지행위", [1], ["5", "5의2"])]),
        ("- 전기통신사업법 제32조의14(판매점 선임): 제32조의4제5항에 따른", [(TB, "named", "32조의14", "판매점 선임", [], []), (TB, "carried", "32조의4", None, [5], [])]),
        ("전파법 제5조① 무선국은 ① 첫째 ② 둘째", [(RADIO, "named", "5조", None, [1], [])]),
        ("업무처리규정 제11조 제1항", [(RULES, "tail", "11조", None, [1], [])]),
        ("「전파법」 제19조~제21조 및 같은 법 시행령 제3조, 동법 제4조", [(RADIO, "named", "19조"), (RADIO, "range", "20조"), (RADIO, "carried", "21조"), ("전파법 시행령", "same", "3조"), (RADIO, "same", "4조")]),
        ("전파법 제1조부터 제30조까지", [(RADIO, "named", "1조"), (RADIO, "carried", "30조")]),
        ("「전기통신사업법」(이하 \"법\"이라 한다) 제3조, 「전파법」 제5조, 법 제6조", [(TB, "named", "3조"), (RADIO, "named", "5조"), (TB, "alias", "6조")]),
        ("「전기통신사업법」에 따르면 영 제7조는", [(DECREE, "short", "7조")]),
        ("정보통신망법 제2조는", [("정보통신망 이용촉진 및 정보보호 등에 관한 법률", "named", "2조")]),
        ("「정보통신망법」 제2조", [("정보통신망 이용촉진 및 정보보호 등에 관한 법률", "named", "2조")]),
        ("전기통신사업법 시행령 제5조와 전기통신사업법시행규칙 제6조", [(DECREE, "named", "5조"), ("전기통신사업법 시행규칙", "named", "6조")]),
        ("실무상 통상적입니다.", []),
    ],
)
def test_citations(text, want):
    got = [(c.act, c.how, c.article, c.title, c.paras, c.items) for c in rf.citations(text, NAMES)]
    assert [g[: len(w)] for g, w in zip(got, want, strict=True)] == want


def test_several_names_end_alike():
    (c,) = rf.citations("업무처리기준 제3조", NAMES)
    assert c.candidates == ["갑 업무처리기준", "을 업무처리기준"]


def test_delegations():
    text = "제1조(목적) 이 고시는 「전기통신사업법」(이하 \"법\"이라 한다) 제50조 및 같은 법 시행령 제42조, 법 제51조의2제1항, 부칙 제3조, 「사과」 제3조에 따라 위임된 것과 「전파법」 제9조"
    found, dropped = rf.delegations(rf.basis_of(text), NAMES)
    assert found == [(TB, "50조", True), (DECREE, "42조", True), (TB, "51조의2", True)]
    assert dropped == [("3조", "addendum"), ("사과", "no act"), ("3조", "no act before it")]
    assert rf.basis_of("1. 대상: 「전파법」 제5조에 따라") == "" and rf.basis_of("1. 대상: 「전파법」 제5조에 따라", strict=False).endswith("에 따라")
    # The only act that is named stands for "the act" and "the decree"; with two it is open.
    assert rf.delegations("이 규정은 법 제3조 및 「전파법」 제4조, 시행령 제5조", NAMES)[0] == [(RADIO, "3조", True), (RADIO, "4조", True), ("전파법 시행령", "5조", False)]
    assert rf.delegations("법 제3조, 「전파법」과 「전기통신사업법」", NAMES) == ([], [("법", "undetermined"), ("3조", "no act before it")])
    assert rf.delegations("전파법은 전기통신사업법 제15조12에 따라", NAMES)[0] == [(TB, "15조의12", True)]
    assert rf.delegations("", NAMES) == ([], [])


def test_status(spark):
    arts = spark.createDataFrame(
        [(TB, "50조", "금지행위", "① 가\n② 나\n5. 다\n5의2. 라"), (TB, "7조", "목적", "한 문단"), (RADIO, "7조", "목적", None), ("갑 업무처리기준", "3조", None, "글"), ("갑 업무처리기준", "4조", "x", "글"), ("을 업무처리기준", "4조", "x", "글"), (RADIO, "99조", "끝", "글")],
        "act string, article string, title string, text string",
    )
    cases = [
        ("전기통신사업법 제50조(금지 행위) 제2항 제5호의2", "exact", None), ("전기통신사업법 제50조제3항", "missing", "part"), ("전기통신사업법 제50조제6호", "missing", "part"),
        ("전기통신사업법 제7조제1항", "exact", None), ("전기통신사업법 제7조제2항", "missing", "part"), ("전기통신사업법 제7조(정의)", "mismatch", "title"), ("전기통신사업법 제8조", "missing", "article"),
        ("「없는 법」 제1조", "missing", "act"), ("제7조", "ambiguous", "several acts"), ("제99조", "exact", None), ("제98조", "missing", "article"),
        ("업무처리기준 제3조", "exact", None), ("업무처리기준 제4조", "ambiguous", "several acts"), ("업무처리기준 제5조", "missing", "article"), (None, None, None), ("", None, None),
    ]
    answers = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, text string")
    got = {r["id"]: (r["status"], r["reason"], r["how"], r["act"]) for r in ct.citation_status(ct.cited(answers, "id", "text", arts, "act"), arts).collect()}
    assert {i: g[:2] for i, g in got.items()} == {i: c[1:] for i, c in enumerate(cases) if c[1]}
    assert got[9][2:] == ("guessed", RADIO) and got[11][2:] == ("guessed", "갑 업무처리기준")


def test_delegation_rows(spark):
    docs = spark.createDataFrame([(1, "이 고시는 「전파법」 제2조 및 「과자」에 따라"), (2, None), (3, "목적 없음")], "id long, text string")
    registry = spark.createDataFrame([("전파법",), ("전파법",), (None,)], "name string")
    rows = [tuple(r) for r in ct.delegation_edges(docs, "id", "text", registry, "name").collect()]
    assert rows == [(1, 0, "전파법", "2조", True, None), (1, 1, None, "과자", None, "no act")]


def test_answers_are_scanned_once(spark):
    """Named, open and ambiguous references are told apart from one scan."""
    arts = spark.createDataFrame([("전파법", "1조", "목적", "x"), ("방송 통신 기본법", "1조", "목적", "x"), ("정보 통신 기본법", "2조", "정의", "x")], "act string, article string, title string, text string")
    texts = ["「전파법」 제1조에 따르면", "통신 기본법 제2조는", "제2조는 그렇다", "기본법 제1조는"]
    answers = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    refs = ct.cited(answers, "id", "text", arts, "act")
    refs = refs.mapInArrow(counted, refs.schema)
    assert len(ct.citation_status(refs, arts).collect()) == 4 and seen.value == 4
