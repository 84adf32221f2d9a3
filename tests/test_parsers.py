"""Worked cases for parsers, briefings, issues and the replacement of tables."""

import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import parsers as pr
from corpusloom.functions import udfs
from corpusloom.functions import vectors as vx
from corpusloom.operators import briefing as br
from corpusloom.operators import events as ev
from corpusloom.operators import graph as gr
from corpusloom.operators import issues as iss
from corpusloom.operators import pairs
from corpusloom.operators import rules as ru
from corpusloom.operators import search as se
from corpusloom.operators import tables as tb


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_definitions(spark):
    body = '''제2조(정의) 이 법에서 사용하는 용어의 뜻은 다음과 같다. <개정 2020. 6. 9.>
1. "전파"란 인공적인 유도(誘導) 없이 공간에 퍼져 나가는 전자기파로서
정한 범위의 것을 말한다.
 - 3 -
2. "무선국(無線局)"이란 설비와 조작하는 자의 총체를 말한다. <개정 2015.1.1>
3. 삭제 <2010. 7. 23.>
4. "국내간사기관"(이하 "간사기관"이라 한다)은 다음 각 목의 기관을 말한다.
  가. 첫째
  나. 둘째
4의2. "이용자"(利用者)라 함은 0.5 이상 2008.6.20부터 쓰는 자.
5. 협정료(accounting rate) : 나누는 기준 요금
6. 그 밖의 것'''
    got = [tuple(d) for d in one(spark, pr.definitions(F.col("b")), b=body)]
    assert [d[:3] for d in got] == [("1", "전파", None), ("2", "무선국", "無線局"), ("4", "국내간사기관", None), ("4의2", "이용자", "利用者"), ("5", "협정료", "accounting rate")]
    assert got[0][3] == '"전파"란 인공적인 유도(誘導) 없이 공간에 퍼져 나가는 전자기파로서 정한 범위의 것을 말한다.'
    assert "\n  가. 첫째" in got[2][3].replace("\n 가.", "\n  가.") and got[1][3].endswith("말한다.")


def test_definitions_by_paragraph(spark):
    body = '''제3조(정의) ① 이 고시의 뜻은 다음과 같다.
1. "갑"이란 가를 말한다.
2. 그 밖의 것 : 나
3. "이름 없는 것
② 앞의 것과 달리 쓰는 "을"(乙)이란 다를 말한다.
③ 다음과 같다.
1. "병"은 라를 말한다.
1. "정"은 마를 말한다.'''
    got = [tuple(d)[:3] for d in one(spark, pr.definitions(F.col("b")), b=body)]
    assert got == [("1", "갑", None), ("2", "그 밖의 것", None), ("2항", "을", "乙"), ("1-2", "병", None), ("1-3", "정", None)]
    assert [tuple(x) for x in one(spark, pr.undefined(F.col("b")), b=body)] == [("3", '"이름 없는 것')]
    assert [tuple(d)[:2] for d in one(spark, pr.definitions(F.col("b")), b='제2조(정의) 이 고시에서 "무"라 함은 바를 말한다.')] == [("본문", "무")]


@pytest.mark.parametrize(("label", "name"), [
    ("\uf90a成泰 위원", "\u91d1成泰"), ("◯김철수 위원 예, 그 자료를 다시 보내 주시기 바랍니다", "김철수"), ("김\u3000철수 위원장 질의하겠습니다", None),
    ("이가람 위원장", "이가람"), ("위원장 이가람", "이가람"), ("홍길동(어느당)", "홍길동"), ("김철수의원", "김철수"), ("장관 박나래", "박나래"),
    ("위원장", "위원장"), ("과학기술정보통신부장관", None), ("마이클브라운", "마이클브라운"), ("의석을 정돈하여 주시기 바랍니다", None), ("", None), (None, None),
])
def test_speaker_name(spark, label, name):
    assert one(spark, pr.speaker_name(F.col("s"), ("위원장", "장관", "위원", "의원", "간사")), s=label) == name


def test_speech_blocks(spark):
    text = "회의록\n머리말\n◯위원장 이가람 \n의석을\n\n\n정돈하여\n◯김철수 위원\n예.\n◯\n이름 없음\n◯박영희 위원\n"
    assert [tuple(b) for b in one(spark, pr.speech_blocks(F.col("t")), t=text)] == [("위원장 이가람", "의석을\n정돈하여"), ("김철수 위원", "예.")]


@pytest.mark.parametrize(("claim", "text", "n", "hits"), [
    ("무선국은 개설허가를 받아야 한다 제19조제1항", "무선국의 개설허가 절차", 2, 2),  # stems of the first two words; the reference and words of every statute are no words
    ("전기통신사업법 제50조에 적합한 신고를, 「전파법 시행령」 제3조", "신고를 적합한 전기통신사업법 전파법", 2, 2),  # names of acts right before a reference are no words
    ("60일 이내에 신고", "60 개를 신고한다", 3, 1),  # two characters are no stem
    ("abc def", "xx ABC", 2, 0),
    ("가는 나는", "가는 나는", 0, 0),  # two characters that end in a particle
    ("[붙임] **굵은글씨** 말", "굵은 글씨", 1, 1),
])
def test_claim_relevance(spark, claim, text, n, hits):
    r = one(spark, pr.claim_relevance(F.col("a"), F.col("b")), a=claim, b=text)
    assert (r["n"], r["hits"]) == (n, hits)


def test_bill_stage_ladder(spark):
    rows = [("원안가결", "폐기", "d", "d", "d", "d"), (" ", "폐기", "d", "d", "d", "d"), (None, "수정가결", None, None, None, None), (None, "심사", "d", None, None, "d"), (None, None, None, "d", "d", "d"), (None, None, "", " ", "d", "d"), (None, None, None, None, None, "d"), (None,) * 6]
    df = spark.createDataFrame(rows, "r string, c string, lp string, ls string, p string, s string")
    got = [r[0] for r in df.select(pr.bill_stage(*(F.col(c) for c in ("r", "c", "lp", "ls", "p", "s")), ("폐기",), ("수정가결",))).collect()]
    assert got == ["원안가결", "폐기", "위원회 의결", "법사위 심사중", "법사위 회부", "소관위 심사중", "소관위 회부", "접수"]


def test_blocks_merge_at_the_first_place(spark):
    queue = [
        (1, "News 2건 today\n\n1. <a href='x'>A</a> (p)\n2. B\n more of B"), (2, "Bill passed"), (3, "News 2건 today\n1. <b>A</b>  (p)\n\n2. C"),
        (4, "News 3건 today\n1. only one"), (5, "News 1건 tomorrow\n1. A (p)"), (6, "1. no head"), (7, "News 1건 today\nstray line\n1. D"), (8, ""),
    ]
    got = {r["place"]: r["text"] for r in br.merged_blocks(spark.createDataFrame(queue, "place int, html string"), "place", "html").collect()}
    assert got.pop(1) == "News 3건 today\n\n1. <a href='x'>A</a> (p)\n\n2. B\n more of B\n\n3. C"
    assert got.pop(5) == "News 1건 tomorrow\n\n1. A (p)"
    assert got == {i: t for i, t in queue if i in (2, 4, 6, 7, 8)}


def test_terms_and_their_variants(spark):
    terms = [("d", 1, "Salt Typhoon"), ("d", 2, "salt-typhoon"), ("d", 3, "AI"), ("d", 4, "AI 기본법"), ("d", 5, "()"), ("d", 6, "설계전력"), ("d", 7, "계약전력"), ("e", 8, "AI")]
    got = br.distinct_terms(spark.createDataFrame(terms, "day string, o int, t string"), ["day"], "o", "t").collect()
    assert sorted((r["day"], r["o"], r["t"]) for r in got) == [("d", 1, "Salt Typhoon"), ("d", 4, "AI 기본법"), ("d", 6, "설계전력"), ("d", 7, "계약전력"), ("e", 8, "AI")]


def plain_fold(terms):
    """The terms that stay, by comparing each with all that stay."""
    kept = []
    for o, t in terms:
        k = re.sub(r"[\s·\-_()]", "", t).lower()
        at = next((i for i, (_, x, y) in enumerate(kept) if k in y or y in k), None)
        if k and at is None:
            kept.append((o, t, k))
        elif k and len(t) > len(kept[at][1]):
            kept[at] = o, t, k
    return [(o, t) for o, t, _ in kept]


def test_terms_that_meet_and_move(spark):
    """Short words of few letters, with much punctuation: places get other keys, and keys stand at several places."""
    pick = random.Random(5)
    days = {d: [(o, "".join(pick.choice("abcde -_(é") for _ in range(pick.randint(1, 9)))) for o in range(400)] for d in "defg"}
    terms = [(d, o, t) for d, own in days.items() for o, t in own]
    pick.shuffle(terms)
    got = br.distinct_terms(spark.createDataFrame(terms, "day string, o int, t string"), ["day"], "o", "t").collect()
    assert sorted((r["day"], r["o"], r["t"]) for r in got) == sorted((d, o, t) for d, own in days.items() for o, t in plain_fold(own))


def test_many_distinct_terms(spark):
    """60,000 terms of a day that all stay; folding them by comparing all takes 1.8 billion comparisons."""
    terms = spark.range(60_000).select(F.lit("d").alias("day"), "id", F.substr(F.md5(F.col("id").cast("string")), F.lit(1), F.lit(16)).alias("t"))
    began = time.monotonic()
    assert br.distinct_terms(terms, ["day"], "id", "t").count() == 60_000
    assert time.monotonic() - began < 90


def test_tables_are_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    first = tb.swapped(spark, spark.range(5), path, ["id"])
    assert first.count() == 5
    assert sorted(r["id"] for r in tb.swapped(spark, spark.range(2, 4), path, ["id"]).collect()) == [2, 3]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        tb.swapped(spark, broken, path, ["id"])
    assert spark.read.parquet(path).count() == 2


def test_failures_hold_back_for_a_while(spark):
    t = lambda h, m=0: datetime(2026, 1, 5, h, m)
    failures = spark.createDataFrame([(1, t(11, 30)), (2, t(10)), (3, t(13)), (4, None), (6, datetime(2025, 1, 1)), (7, datetime(2026, 2, 1))], "id int, failed_at timestamp")
    clock = F.lit("2026-01-05 12:00:00").cast("timestamp")
    assert sorted(r["id"] for r in ev.due_for_retry(spark.createDataFrame([(i,) for i in range(1, 6)], "id int"), "id", failures, clock, 60).collect()) == [2, 3, 4, 5]
    assert sorted(r["id"] for r in ev.kept_failures(failures, clock, 30).collect()) == [1, 2, 3]


def test_family_and_self_references(spark):
    names = ["전파법", "전파법 시행령", "전파법 시행규칙", "통신법", "통신법 시행규칙", "고아 시행령"]
    docs = spark.createDataFrame([(n, "법 제3조와 영 제4조, 방법 제5조, 법 제6조") for n in names], "n string, t string")
    assert sorted(map(tuple, gr.family_edges(docs, "n").collect())) == [("전파법", "전파법 시행령"), ("전파법 시행령", "전파법 시행규칙"), ("통신법", "통신법 시행규칙")]
    got = {(r["source"], r["target"]): r["n"] for r in gr.self_references(docs, "n", "t").collect()}
    assert got == {("전파법 시행령", "전파법"): 2, ("전파법 시행규칙", "전파법"): 2, ("전파법 시행규칙", "전파법 시행령"): 1, ("통신법 시행규칙", "통신법"): 2, ("통신법 시행규칙", "통신법 시행령"): 1, ("고아 시행령", "고아"): 2}


def test_news_rank_wants_evidence(spark):
    rows = [
        (1, "ABC 주파수 경매", "ABC 주파수 경매 본문", "e1"), (2, "ABC 주파수 경매 속보", "ABC 주파수", "e2"), (3, "주파수 재할당", "경매 없이", "e1"), (4, "야구 소식", "ABC 주파수 경매", ""),
        (5, "현장주파수장 이야기", "아무 말", ""), (6, "다른 ABCX 이야기", "경매", ""), (7, "ABC 주파수 경매", "같은 제목", ""), (8, "주파수 정책", "", ""),
    ]
    df = spark.createDataFrame(rows, "id int, title string, body string, event string").withColumn("at", F.lit(None).cast("timestamp"))
    got = [(r["id"], r["place"]) for r in se.news_rank(df, "id", "title", "body", "event", "at", ["ABC", "주파수", "경매"]).orderBy("place").collect()]
    assert got[0] == (1, 1) and {i for i, _ in got} & {2, 4, 6, 7, 8} == set()  # 2 has a like title, 4 no title hit, 6 no whole word, 7 a known title, 8 no body
    assert se.news_rank(df, "id", "title", "body", "event", "at", ["주파수"], common=2).count() == 0


def test_word_hits_by_alphabet(spark):
    cases = [("5G는 좋다", "5G", True), ("15G", "5G", False), ("5Gs", "5g", False), ("현장애로", "장애", False), ("장애로", "장애", True), ("통신장애", "장애", True), ("x장애y", "장애", True), ("개인정보보호", "정보보", True)]
    for text, word, want in cases:
        assert one(spark, se.word_hit(F.col("t"), word), t=text) is want, (text, word)


def test_lost_characters(spark):
    from corpusloom.functions.udfs import repaired_text

    other = "제1조 「전파법」 제3조·제4조에\n따른 주파수 – 대역\n정말인가? 그렇다"
    assert repaired_text("제1조 ?전파법? 제3조?제4조에 따른", other) == ("제1조 「전파법」 제3조·제4조에 따른", 3)
    assert repaired_text("주파수 ? 대역", other) == ("주파수 – 대역", 1)
    assert repaired_text("정말인가? 그렇다", other) == ("정말인가? 그렇다", 0)  # it is one there, too
    assert repaired_text("가나?다라", "가나x다라") == ("가나?다라", 0)  # letters are not taken, nor is the one that looks like a dot
    assert repaired_text("가나?다라", "가나\u318d다라") == ("가나?다라", 0)
    assert repaired_text("가나?다라", "가나·다라 가나-다라") == ("가나?다라", 0)  # two candidates
    assert repaired_text("a?b", "a·b") == ("a?b", 0)  # too little around it
    assert repaired_text("", "x") == ("", 0) and repaired_text("가나?다라", "") == ("가나?다라", 0)


def test_definitions_of_long_articles(spark):
    """Numbers of four digits count at the start of a line; numbers that repeat are told apart."""
    body = "제2조(정의) 뜻이다.\n" + "\n".join(f'{i}. "t{i}"란 2020. "x"라 함은 것이다.' for i in range(1, 3_001)) + '\n② 또\n' + "\n".join(f'{i}. "u{i}"란 것이다.' for i in (7, 7, 1_500, 9_000))
    got = [tuple(d)[:2] for d in one(spark, pr.definitions(F.col("b")), b=body)]
    assert got == [(str(i), f"t{i}") for i in range(1, 3_001)] + [("7-2", "u7"), ("7-3", "u7"), ("1500-2", "u1500"), ("9000", "u9000")]


def join_rows(df):
    """The rows that the largest join of a query has made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_a_key_that_many_issues_hold_is_met_once(spark):
    state = F.element_at(F.array(*map(F.lit, ["merged", "rejected", "proposed", "active"])), (F.col("id") % 4 + 1).cast("int"))
    held = spark.range(1_000).select((F.col("id") + 7).alias("issue"), state.alias("state"), F.array(F.lit("k"), F.concat(F.lit("own"), F.col("id"))).alias("keys"))
    items = spark.range(1_000).select(F.col("id").alias("item"), F.array(F.when(F.col("id") < 990, "k").otherwise("none"), F.concat(F.lit("own"), F.col("id"))).alias("keys"))
    out = iss.same_regulation(items, "item", "keys", held)
    assert 0 < join_rows(out) < 2_000
    got = {r["item"]: (r["state"], r["issue"]) for r in out.collect()}
    late = {i: ({1: "rejected", 2: "proposed", 3: "active"}[i % 4], i + 7) for i in range(990, 1_000) if i % 4}
    assert got == {i: ("active", 10) for i in range(990)} | late


def test_a_plan_joins_packs(spark):
    """50 subscribers by 2,000 rows of an hour: a row a pair, but packs are joined."""
    at = lambda minutes: F.timestamp_seconds(F.lit(1_767_571_200) + minutes * 60)
    queue = spark.range(2_000).select(F.col("id").alias("item"), at(F.col("id") % 50).alias("created_at"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).alias("tags"))
    people = spark.range(50).select(F.col("id").alias("subscriber"), at(F.col("id")).alias("watermark"), F.array(F.lit("b")).alias("tags"))
    out = ev.delivery_plan(queue, people, at(F.lit(120)), 15).select("subscriber", "item", "deliver")
    assert 0 < join_rows(out) <= 50 * 4
    assert sorted(map(tuple, out.collect())) == [(s, i, i % 2 == 1) for s in range(50) for i in range(2_000) if i % 50 > s]


def test_a_stored_plan_takes_little_for_a_pair(spark, tmp_path):
    """96 subscribers by 24,000 rows of an hour: more rows than a page of a file holds lie between no two equal items."""
    at = lambda seconds: F.timestamp_seconds(F.lit(1_767_571_200) + seconds)
    queue = spark.range(24_000).select((F.col("id") * 1_000_003).alias("item"), at(F.col("id") % 3_000).alias("created_at"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).alias("tags"))
    people = spark.range(96).select(F.col("id").alias("subscriber"), at(F.when(F.col("id") % 8 == 0, F.col("id") * 31).otherwise(-1)).alias("watermark"), F.array(F.lit("b")).alias("tags"))
    ev.delivery_plan(queue, people, at(F.lit(7_200)), 15).select("subscriber", "item", "deliver").write.parquet(f"{tmp_path}/plan")
    got = spark.read.parquet(f"{tmp_path}/plan")
    wanted = {s: 24_000 if s % 8 else 8 * (2_999 - s * 31) for s in range(96)}
    assert {r["subscriber"]: r["n"] for r in got.groupBy("subscriber").agg(F.count_distinct("item").alias("n")).collect()} == {s: n for s, n in wanted.items() if n > 0}
    late = (F.col("item") / 1_000_003 % 3_000 > F.col("subscriber") * 31) | (F.col("subscriber") % 8 != 0)
    assert got.count() == got.filter(late & (F.col("deliver") == (F.col("item") / 1_000_003 % 2 == 1))).count() == sum(n for n in wanted.values() if n > 0)
    assert sum(f.stat().st_size for f in (tmp_path / "plan").glob("*.parquet")) < 0.7 * got.count()


def test_blocks_of_rules_share_a_worker(spark):
    rules = [(True, i, f"r{i}", "set", "urgent", [f"w{i} "], [], []) for i in range(40)]
    rules = spark.createDataFrame(rules, "enabled boolean, position int, id string, mode string, level string, any_words array<string>, and_any array<array<string>>, none_words array<string>")
    items = spark.createDataFrame([(i, f"x w{i + 20} w{i} ." if i % 2 else f"w{i} .") for i in range(60)] + [(60, None)], "id int, text string")
    out = ru.first_rule(items, "text", "id", rules, inline=0, block=3)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["id"]: r["rule_id"] for r in out.collect()} == {i: f"r{i}" if i < 40 else None for i in range(60)} | {60: None}


def test_signs_are_found_as_by_a_pattern():
    pick = random.Random(3)
    for _ in range(5_000):
        bare = "".join(pick.choice("ab(") for _ in range(pick.randint(1, 12)))
        a, b = ("".join(pick.choice("ab(") for _ in range(pick.randint(0, 3))) for _ in "ab")
        if a or b:
            want = {m[1] for m in re.finditer(f"(?={re.escape(a)}(.){re.escape(b)})", bare)}
            got = udfs._between(bare, a, b)
            assert got == want if len(want) < 2 else len(got) == 2 and got <= want


def test_no_pattern_is_built_for_a_sign(monkeypatch):
    monkeypatch.setattr(udfs.re, "escape", lambda _: pytest.fail("a pattern for each lost sign"))
    assert udfs.repaired_text("?1234567? why?", "page 「1234567」 why? end") == ("「1234567」 why?", 2)


def test_pairs_of_vectors_are_those_of_the_formula(spark):
    """Three blocks a side, with vectors that are null, empty, zero, longer, equal, or not finite."""
    pick = random.Random(8)
    vectors = [[pick.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    odd = [None, [], [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [1.0] * 6, [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0]]
    rows = spark.createDataFrame([(i, None if i % 13 == 0 else f"k{i % 2}", ([*vectors, *odd, vectors[3], vectors[3]])[i % 69]) for i in range(150)], "id long, k string, v array<double>")
    other = rows.select(F.col("id").alias("o"), F.col("k").alias("ok"), F.col("v").alias("w"))
    plain = rows.join(other, F.col("k") == F.col("ok")).select("k", "id", "o", vx.cosine(F.col("v"), F.col("w")).alias("similarity")).filter("similarity is not null")
    pairs.BLOCK, old = 25, pairs.BLOCK
    try:
        got = pairs.cosine_pairs(rows, "id", "v", rows.withColumnRenamed("id", "o"), "o", "v", ["k"], 0.7).collect()
        best = pairs.cosine_pairs(rows, "id", "v", rows.withColumnRenamed("id", "o"), "o", "v", ["k"])
        best = best.groupBy("k", "id").agg(F.max(F.struct("similarity", -F.col("o"))).alias("m")).collect()
    finally:
        pairs.BLOCK = old
    assert sorted(map(repr, got)) == sorted(map(repr, plain.filter("similarity >= 0.7").collect())) and len(got) > 150
    assert sorted(map(repr, best)) == sorted(map(repr, plain.groupBy("k", "id").agg(F.max(F.struct("similarity", -F.col("o"))).alias("m")).collect()))


def test_best_issues_are_found_without_a_cross_join(spark):
    issues = spark.createDataFrame([(1, "active", "a", [1.0, 0.0])], "issue long, state string, key string, vector array<double>")
    out = iss.best_by_state(spark.createDataFrame([(7, [1.0, 1.0], "a")], "c long, v array<double>, k string"), "c", "v", "k", issues)
    assert not re.search("CartesianProduct|NestedLoop", out._jdf.queryExecution().executedPlan().toString())
    assert [(r["active_issue"], round(r["sim_active"], 6)) for r in out.collect()] == [(1, 0.707107)]
