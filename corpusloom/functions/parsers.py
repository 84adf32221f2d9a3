"""Parsers of titles, bills, claims, definitions and speech, as built-in expressions. The patterns and words are fixed
values: they are the notation of what is parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.chunks import let
from corpusloom.functions.udfs import nfkc

#: Scores of games, corner names, and hosts of sports and entertainment pages.
SPORTS = r"\b[36]G\b\s*\d*\s*(연속|무패|무실점|타점|타수|안타|홈런|골|승|패|세이브|QS|경기|보살)|\[\s*LTE\b[^\]]*\]|^LTE\)"
SPORTS_HOSTS = ("sports.naver.com", "entertain.naver.com")
#: Ministries, and words of personnel news.
MINISTRIES = ("과기정통부", "과학기술정보통신부", "과기부", "방통위", "방송통신위원회", "방미통위", "방송미디어통신위원회", "국립전파연구원", "중앙전파관리소")
PERSONNEL = ("인사", "임명", "취임", "내정", "발탁", "승진", "경질", "교체", "인사이동", "인사발령", "이동", "전보", "보직", "차관", "장관", "실장", "국장")
#: What a page says where its body should be; what a chair says between speeches.
NON_BODY = r"^\s*(?:많이\s*본\s*(?:기사|뉴스)|실시간\s*인기\s*(?:기사|뉴스)|최신\s*뉴스|(?:저작권법\s*제37조\s*및\s*)?-\s*제37조\s*\(출처의\s*명시\))"
CHAIR = r"(잠깐만|잠시만|기다려\s*주|수고하셨|나와\s*계세요|나오세요|말씀하십시오|다음은\s*\S+\s*위원님|이상입니다)"


def sports_noise(title: Column, url: Column) -> Column:
    """News on games that a search for network names finds."""
    hosts = F.lit(False)
    for host in SPORTS_HOSTS:
        hosts = hosts | F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(host))
    return F.coalesce(title, F.lit("")).rlike(SPORTS) | hosts


def personnel_news(title: Column) -> Column:
    """A ministry, and a word of personnel news."""
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(title, F.lit("")), w))
    return any_of(MINISTRIES) & any_of(PERSONNEL)


def non_body(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NON_BODY)


def noise_speech(text: Column, least: int = 18, most: int = 60) -> Column:
    """Nothing, fewer than least characters, or fewer than most with a phrase of the chair's."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return (F.length(t) < least) | (t.rlike(CHAIR) & (F.length(t) < most))


def bill_stage(result: Column, committee: Column, law_present: Column, law_submit: Column, present: Column, sent: Column, terminal: tuple[str, ...], passed: tuple[str, ...]) -> Column:
    """The furthest stage that a bill's milestones show: a result stands as it is, then the committee's verdict, then the
    first of the dates that is there. Blank is missing."""
    has = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""
    verdict = F.trim(F.coalesce(committee, F.lit("")))
    return (
        F.when(has(result), F.trim(result)).when(verdict.isin(*terminal), verdict).when(verdict.isin(*passed), "위원회 의결")
        .when(has(law_present), "법사위 심사중").when(has(law_submit), "법사위 회부").when(has(present), "소관위 심사중").when(has(sent), "소관위 회부").otherwise("접수")
    )


def compared(text: Column) -> Column:
    """A quotation without emphasis, tags, white space, dots, quotes and punctuation."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\*\*", ""), r"\[[^\]]*\]", "")
    return F.regexp_replace(plain, "[\\s·ㆍ‧•'\"“”‘’「」『』()（）\\[\\],.:;、。…\\-—–|]", "")


# Words that stand in every statute and prove nothing; how a name of an act ends.
STATUTE_WORDS = (
    "경우 또는 이하 이상 이내 이전 따라 따른 바에 정하는 정한 대통령령 대통령령으로 과학기술정보통신부장관 과학기술정보통신부장관에게 과학기술정보통신부장관은 장관 규정 조항 내용 사항 "
    "하여야 한다 있다 없다 때에는 밖에 해당 관련 다음 각호 어느 하나에 해당하는 위하여 대하여 관하여 필요한 경우에는 가능 여부 기준 방법 절차 대한 의한 관한 있는 없는 하는 되는 하고 하며 "
    "받아야 받은 하거나 포함 제외 이를 그에 이에 대해 통해 위해 등을 등의 등에 경우로 경우에 때 및 등 수 것 그 이 로서 로써"
).split()
NAME_END = "(?:법률|법|시행령|시행규칙|규칙|고시|규정|기준|세칙|지침|약관)"
#: A name right before a reference: in quotes, or the word (with a word for its decree) that ends like one.
CITED_NAME = rf"(?:「[^」]*」|(?:[가-힣A-Za-z0-9·ㆍ]*{NAME_END}\s+)?[가-힣A-Za-z0-9·ㆍ]*{NAME_END})\s*(?:\([^)]*\))?(?=\s*(?:제\s?\d+\s?조|별표|별지))"


def claim_relevance(claim: Column, text: Column, stops: tuple[str, ...] = tuple(STATUTE_WORDS)) -> Column:
    """struct(n, hits, score): of a claim's distinct words, those that the text has.

    References to articles, paragraphs and items, the names of acts right before them, digits alone, stops and single
    characters are no words; nor are two characters of which the last is a particle. A word is hit as it stands or
    without its last one or two characters, if they are Hangul and three are left.
    """
    bare = F.regexp_replace(F.regexp_replace(claim, r"\[[^\]]*\]", " "), r"\*\*", " ")
    bare = F.regexp_replace(bare, CITED_NAME, " ")
    bare = F.regexp_replace(bare, r"제\s?\d+\s?조(?:\s?의\s?\d+)?(?:\s?\([^)]*\))?|제\s?\d+\s?[항호](?:\s?의\s?\d+)?|[①-⑳]", " ")
    words = F.array_distinct(F.split(bare, r"[^가-힣A-Za-z0-9]+"))
    stop = F.array(*map(F.lit, stops)).cast("array<string>")
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, w) & ~((F.length(w) == 2) & w.rlike("[은는이가을를의에로와과도만]$")))
    body = compared(text)

    def hit(w: Column) -> Column:
        cut = lambda k: F.substr(w, F.lit(1), F.length(w) - k)
        short = lambda k, tail: (F.length(w) - k >= 3) & ~cut(k).rlike(r"^\d+$") & w.rlike(tail) & F.contains(body, cut(k))
        return F.contains(body, w) | short(1, "[가-힣]$") | short(2, "[가-힣]{2}$")

    n, hits = F.size(words), F.size(F.filter(words, hit))
    return F.struct(n.alias("n"), hits.alias("hits"), F.when(n > 0, F.round(hits / n, 6)).otherwise(0.0).alias("score"))


def is_evidence(relevance: Column, least: int = 2, score: float = 0.2) -> Column:
    return (relevance["hits"] >= least) & (relevance["score"] >= score)


#: The notation of definitions in statutes. Numbers of four and more digits, which may be years in a sentence,
#: count at the start of a line only.
ITEM = r"(?<!\d)(?<!\d\.)(\d{1,3}(?:의\d{1,2})?|(?<=\n)\d{4,}(?:의\d{1,2})?)\.\s*(?=[\"“]|삭제|[가-힣A-Za-z][^:\n\"“]{0,40}\s?:)"
QUOTED = r"^[\"“](.{1,120}?)[\"”]\s*(?:\(([^()]{1,60})\))?\s*(?:이?란|이?라\s*함은|이?라고\s*함은|은|는)(?![가-힣])"
COLON = r"^([^:\n\"“]{1,60}?)\s*:\s*"


#: The signs of paragraphs, which say where numbering starts anew.
PARAGRAPHS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def _definition_items(body: Column) -> Column:
    """array of struct(no, text) of an article of definitions: its items, cleaned, deleted and empty ones left out. In a
    paragraph without numbered items, what follows its first quoted term; a number that repeats gets -2, -3 and so on."""
    text = F.regexp_replace(F.regexp_replace(body, r"\n\s*-\s*\d+\s*-\s*\n", "\n"), r"^\s*제\s*\d+조(?:의\d+)?\s*\([^)]*\)\s*", "")
    sections = F.filter(F.split(text, f"(?=[{PARAGRAPHS}])"), lambda s: F.trim(s) != "")

    def items(section: Column) -> Column:
        sign = F.regexp_extract(section, f"^([{PARAGRAPHS}])", 1)
        own = F.regexp_replace(section, f"^[{PARAGRAPHS}]", "")
        parts = F.filter(F.split(F.regexp_replace(own, ITEM, "\u0001$1\u0002"), "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
        numbered = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("\u0002"), F.lit(1)).alias("no"), F.split_part(p, F.lit("\u0002"), F.lit(2)).alias("raw")))
        place = F.regexp_instr(own, F.lit(QUOTED[1:]))
        name = F.when(sign != "", F.concat(F.instr(F.lit(PARAGRAPHS), sign).cast("string"), F.lit("항"))).otherwise("본문")
        lone = F.array(F.struct(name.alias("no"), F.substr(own, place).alias("raw")))
        return F.when(F.size(parts) > 0, numbered).when(place > 0, lone).otherwise(F.array().cast("array<struct<no:string,raw:string>>"))

    def clean(x: Column) -> Column:
        bare = F.regexp_replace(F.trim(F.regexp_replace(x["raw"], r"</?[a-zA-Z][^<>]*>", "")), r"\s*<(?:개정|신설|전문개정|삭제)[^>]*>\s*$", "")
        bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\n(?!\s*[가-힣][.)]\s)", " "), r"[ \t]+", " "))
        return F.struct(x["no"].alias("no"), bare.alias("text"))

    return F.filter(F.transform(F.flatten(F.transform(sections, items)), clean), lambda x: (x["text"] != "") & ~F.startswith(x["text"], F.lit("삭제")))


def _defines(x: Column) -> Column:
    return x["text"].rlike(QUOTED) | x["text"].rlike(COLON)


def _renumbered(d: Column, before: Column) -> Column:
    no = F.when(before > 0, F.concat(d["item_no"], F.lit("-"), (before + 1).cast("string"))).otherwise(d["item_no"])
    return F.struct(no.alias("item_no"), d["term"].alias("term"), d["alias"].alias("alias"), d["definition"].alias("definition"))


def definitions(body: Column) -> Column:
    """array of struct(item_no, term, alias, definition) of an article of definitions.

    Items start at their number, which starts anew in each paragraph: a number that was there before gets -2, -3 and so
    on. A paragraph without items that has a term in quotes is one definition, named by its paragraph. Deleted items are
    left out; what does not define anything is listed by undefined(). A term stands in quotes before its marker, or before
    a colon; an alias stands in brackets behind or inside it, unless it is an abbreviation for what follows.
    """

    def named(x: Column) -> Column:
        t = x["text"]
        quoted = t.rlike(QUOTED)
        term = F.trim(F.when(quoted, F.regexp_extract(t, QUOTED, 1)).otherwise(F.regexp_extract(t, COLON, 1)))
        behind = F.when(quoted, F.nullif(F.trim(F.regexp_extract(t, QUOTED, 2)), F.lit("")))
        behind = F.when(~F.startswith(behind, F.lit("이하")), behind)
        bare = F.regexp_replace(term, r"\s*[\(（]\s*이하.*$", "")
        bare = F.when(F.trim(bare) != "", F.trim(bare)).otherwise(term)
        inner = r"^(.*?)\s*[\(（]([^()（）]{1,60})[\)）]\s*$"
        inside = F.nullif(F.trim(F.regexp_extract(bare, inner, 2)), F.lit(""))
        head = F.trim(F.regexp_extract(bare, inner, 1))
        return F.struct(x["no"].alias("item_no"), F.when(inside.isNotNull() & (head != ""), head).otherwise(bare).alias("term"), F.coalesce(behind, F.when(~F.startswith(inside, F.lit("이하")), inside)).alias("alias"), t.alias("definition"))

    found = F.filter(F.transform(F.filter(_definition_items(body), _defines), named), lambda d: d["term"] != "")

    def numbered(ds: Column) -> Column:
        return F.when(F.size(F.array_distinct(ds["item_no"])) == F.size(ds), ds).otherwise(let(F.array_sort(F.transform(ds, lambda d, i: F.struct(d["item_no"].alias("no"), i.alias("i"), d.alias("d")))), apart))

    def apart(rows: Column) -> Column:
        """Rows in order of number, then place: a run of equal numbers starts where the row before has another one."""
        last = F.size(rows)
        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | (F.get(rows, i)["no"] != F.get(rows, i - 1)["no"]))
        runs = let(starts, lambda ss: F.transform(ss, lambda s, r: F.slice(rows, s + 1, F.coalesce(F.get(ss, r + 1), last) - s)))
        again = F.flatten(F.transform(runs, lambda run: F.transform(run, lambda x, k: F.struct(x["i"].alias("i"), _renumbered(x["d"], k).alias("d")))))
        return F.transform(F.array_sort(again), lambda x: x["d"])

    return let(found, numbered)


def undefined(body: Column, most: int = 80) -> Column:
    """array of struct(item_no, head) of the items that define nothing, with their first most characters."""
    return F.transform(F.filter(_definition_items(body), lambda x: ~_defines(x)), lambda x: F.struct(x["no"].alias("item_no"), F.substr(x["text"], F.lit(1), F.lit(most)).alias("head")))


def speech_blocks(text: Column, mark: str = "◯") -> Column:
    """array of struct(label, text): blocks that start at a mark on a new line; the rest of that line says who speaks."""
    parts = F.filter(F.split(text, f"\n(?={mark})"), lambda p: F.startswith(p, F.lit(mark)))
    cut = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, f"^{mark}([^\n]*)", 1)).alias("label"), F.trim(F.regexp_replace(F.regexp_extract(p, r"(?s)^[^\n]*\n?(.*)$", 1), r"\n{2,}", "\n")).alias("text")))
    return F.filter(cut, lambda b: (b["label"] != "") & (b["text"] != ""))


#: Offices that may stand right behind a name.
OFFICES = "위원장 부위원장 소위원장 위원 의원 간사 장관 차관 청장 처장 원장 소장 본부장 단장 실장 국장 이사장 사장 대표".split()


def speaker_name(name: Column, titles: tuple[str, ...]) -> Column:
    """The name in a speaker's label: without brackets, and without up to two titles before and two behind it, which may
    be joined to it if two to four characters are left. Names have two to five characters; else a name of two to four
    letters of Hangul with an office behind it at the head counts (where a speech has run into its label), else up to six
    of Hangul alone, and anything else is unknown (null). Compatibility forms of characters count as the characters."""
    return let(F.trim(F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), r"\s+", " ")), lambda raw: _name_in(raw, titles))


def _name_in(raw: Column, titles: tuple[str, ...]) -> Column:
    n = F.trim(F.regexp_replace(raw, r"\s*[\(（][^)）]*[\)）]", ""))
    before = lambda n: F.filter(F.array(*map(F.lit, titles)), lambda t: F.startswith(n, F.concat(t, F.lit(" "))))
    without = lambda n, t: F.trim(F.substr(n, F.lit(1), F.length(n) - F.length(t)))
    behind = lambda n: F.filter(F.array(*map(F.lit, titles)), lambda t: F.endswith(n, F.concat(F.lit(" "), t)) | (F.endswith(n, t) & F.length(without(n, t)).between(2, 4)))
    for _ in range(2):
        n = let(n, lambda n: let(before(n), lambda ts: F.when(F.size(ts) > 0, F.trim(F.substr(n, F.length(ts[0]) + 2, F.length(n)))).otherwise(n)))
    for _ in range(2):
        n = let(n, lambda n: let(behind(n), lambda ts: F.when(F.size(ts) > 0, without(n, ts[0])).otherwise(n)))
    head = F.regexp_replace(raw, r"[◯○\s]+", "")
    officer = F.regexp_extract(raw, rf"^[◯○\s]*([가-힣]{{2,4}})\s*(?:{'|'.join(OFFICES)})", 1)
    return let(n, lambda n: F.when(F.length(n).between(2, 5), n).when(officer != "", officer).when(F.length(head).between(2, 6) & head.rlike("^[가-힣]+$"), head))
