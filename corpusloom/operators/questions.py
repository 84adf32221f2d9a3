"""Questions about minutes, taken apart: who spoke, when, at what kind of meeting, and what about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that say that something is asked, not what about.
ASKING = (
    "관련해서 관련해 관련된 관련 대해서 대해 대한 관하여 관한 관해 발언한 발언했던 발언 발언들 내용을 내용 얘기 얘기한 이야기 이야기한 말한 말씀 하신 언급한 언급 입장 질의한 질의 답변한 답변 "
    "찾아줘 찾아 알려줘 알려 보여줘 보여 검색해줘 검색 조회 무엇 뭐라고 어떤 무슨 해줘 주세요 좀 그 이 저 모두 전부 회의록 회의 국회 과방위 미방위 위원회 위원장 소위 논의 나온 있던 에서 에 의 을 를 은 는 이"
).split()
#: What stands before "member" and is no name.
NO_NAME = "대해 대한 관해 어떤 무슨 소속 해당 우리 전체 모든 방송통신 정보통신 과학기술 여야 일부 다른 각 국회 상임 소속당 야당 여당".split()
#: Forms of verbs, of "about", of people and of committees, which are no words to search for.
NO_WORD = (
    r"(했는지|하는지|한지|했나|하나요|했나요|있었나|있나|있는지|였는지|이었나|됐는지|되는지|드립니다|합니다|했어요|한다)$",
    r"^(발언|언급|논의|질의|답변|제기|지적|말|얘기|이야기|말씀)(한|된|하신|했던|되었던|드린)$",
    r"^관련(되어|되었던|된|하여|한|해서|해|있는|있던)?$",
    r"^(국회)?(의원|위원|위원장|의장|장관|차관|참고인|증인)(님들|님|들)?(이|은|는|께서|도|과|와)?$",
    r"위원회$",
)
#: Particles of several letters, which are cut, and of one, which are cut if two letters stay.
LONG_PARTICLE = "(에서는|에서도|에게서|에서|에게|으로|로써|로서|부터|까지|에는|에도|이나|라는)$"
SHORT_PARTICLE = "(을|를|은|는|의|에)$"
SPEAKER = r"([가-힣]{2,4})\s*(?:의원|위원)(?!회|들|님들)"
SPAN = r"(?:최근|근래|요즘|과거|지난|이전)\s*(\d{1,2})\s*년\s*(?:간|동안|치)?"
YEARS = r"(?:20)?(\d{2})\s*년?\s*(?:~|-|부터|에서)\s*(?:20)?(\d{2})\s*년"
YEAR = r"(?<![0-9])((?:20)?\d{2})\s*년"
TERM = r"제?\s*(\d{1,2})\s*대(?:\s*국회)?"
KINDS = {"국정감사": "국정감사|국감", "상임위": "상임위|전체회의|법안소위|소위원회"}
KIND_WORDS = "국정감사|국감|상임위원회|상임위|전체회의|법안소위|소위원회"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _cut(text: Column, pattern: str, when: Column) -> Column:
    """text without the first match of pattern, if when holds."""
    return F.when(when, F.concat_ws(" ", F.regexp_extract(text, rf"(?s)^(.*?)(?:{pattern})", 1), F.regexp_replace(text, rf"(?s)^.*?(?:{pattern})", ""))).otherwise(text)


def parsed_questions(questions: DataFrame, text: str, first_year: int, last_year: int, terms: tuple[int, ...] = (20, 21, 22), most: int | None = 2) -> DataFrame:
    """questions with speaker, year, year_from, year_to, term, other_term, kinds (array) and query (words, at most most of
    them, as every word has to stand in what is found).

    In this order, each taking its words out of the text: a name before "member" (no group of members, no word of
    NO_NAME); a span of years back from last_year, that year included; else a range of years; else one year, which needs
    its word behind it; a term (other_term if it is none of terms, which is no word to search for either); kinds of
    meetings. Years outside first_year to last_year are none, two digits count from 2000. Of what is left particles are
    cut, and words of asking go. If nobody is named and the text has but two words, both worth searching for, a first one
    of two to four letters is the speaker. Null texts give nulls and no words.
    """
    held = lambda n: F.when(n.between(first_year, last_year), n)
    year_of = lambda c: held(F.when(c.cast("int") >= 100, c.cast("int")).otherwise(2000 + c.cast("int")))
    rest = F.col("_rest")
    out = questions.withColumn("_rest", F.concat(F.lit(" "), F.trim(text), F.lit(" ")))
    out = out.withColumn("_name", _first(rest, SPEAKER)).withColumn("speaker", F.when(~F.col("_name").isin(NO_NAME), F.col("_name")))
    out = out.withColumn("_rest", _cut(rest, SPEAKER, F.col("speaker").isNotNull()))
    out = out.withColumn("_n", _first(rest, SPAN).cast("int")).withColumn("_rest", _cut(rest, SPAN, F.col("_n").isNotNull()))
    back = F.when(F.col("_n").between(1, last_year - first_year + 1), F.greatest(F.lit(first_year), last_year - F.col("_n") + 1))
    out = out.withColumn("year_from", back).withColumn("year_to", F.when(back.isNotNull(), last_year))
    a, b = (year_of(_first(rest, YEARS, k)) for k in (1, 2))
    open_ = F.col("year_from").isNull()
    out = out.withColumn("_a", F.when(open_, F.least(a, b))).withColumn("_b", F.when(open_, F.greatest(a, b))).withColumn("_both", a.isNotNull() & b.isNotNull())
    ranged = open_ & F.col("_both")
    out = out.withColumns({"_rest": _cut(rest, YEARS, ranged), "year_from": F.when(ranged, F.col("_a")).otherwise(F.col("year_from")), "year_to": F.when(ranged, F.col("_b")).otherwise(F.col("year_to"))})
    out = out.withColumn("year", F.when(F.col("year_from").isNull(), year_of(_first(rest, YEAR)))).withColumn("_rest", _cut(rest, YEAR, F.col("year").isNotNull()))
    out = out.withColumn("_t", _first(rest, TERM).cast("int")).withColumn("_rest", _cut(rest, TERM, F.col("_t").isNotNull()))
    known = F.col("_t").isin(*terms)
    out = out.withColumns({"term": F.when(known, F.col("_t")), "other_term": F.when(~known, F.col("_t"))})
    out = out.withColumn("kinds", F.array_compact(F.array(*(F.when(rest.rlike(p), F.lit(k)) for k, p in KINDS.items())))).withColumn("_rest", F.regexp_replace(rest, KIND_WORDS, " "))
    raw = F.filter(F.transform(F.split("_rest", r"[\s,·]+"), lambda w: F.regexp_replace(w, "[^가-힣A-Za-z0-9]", "")), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, LONG_PARTICLE, "")
    short = lambda w: F.when(F.length(w) >= 3, F.regexp_replace(w, SHORT_PARTICLE, "")).otherwise(w)
    asked = lambda w: (F.length(w) >= 2) & ~w.isin(ASKING) & ~reduce(lambda x, p: x | w.rlike(p), NO_WORD, F.lit(False))
    out = out.withColumn("_raw", raw)
    out = out.withColumn("_words", F.filter(F.transform(F.transform("_raw", bare), short), asked))
    promoted = F.col("speaker").isNull() & (F.size("_raw") == 2) & (F.size("_words") == 2) & F.get("_words", F.lit(0)).rlike("^[가-힣]{2,4}$")
    out = out.withColumn("_promoted", F.coalesce(promoted, F.lit(False)))
    words = F.when(F.col("_promoted"), F.slice("_words", 2, 1 << 30)).otherwise(F.col("_words"))
    out = out.withColumn("speaker", F.when(F.col("_promoted"), F.get("_words", F.lit(0))).otherwise(F.col("speaker")))
    out = out.withColumn("query", F.array_join(words if most is None else F.slice(words, 1, most), " "))
    return out.select(*questions.columns, "speaker", "year", "year_from", "year_to", "term", "other_term", "kinds", "query")
