"""Keyword, trigram and vector search, and the fusion of their rankings. Top-k lists end on the id, so ties are settled."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.functions.udfs import gram_rows
from corpusloom.operators.tables import first_per
from corpusloom.session import checkpointed, ship_package


def hit_matrix(docs: DataFrame, doc_id: str, text: str, keywords: list[str]) -> DataFrame:
    """doc_id, ord for each keyword that the text has: one pass over the texts, with the keywords as literals."""
    hits = [F.when(tx.keyword_hit(F.col(text), F.lit(k)), F.lit(i)) for i, k in enumerate(keywords, 1)]
    return docs.select(F.col(doc_id), F.explode(F.array_compact(F.array(*hits))).alias("ord"))


def any_keyword_score(docs: DataFrame, doc_id: str, text: str, keywords: list[str], k: int) -> DataFrame:
    """doc_id, score (keywords hit), chars: best first, shorter texts first among equals."""
    score = sum((tx.keyword_hit(F.col(text), F.lit(w)).cast("int") for w in keywords), F.lit(0))
    return docs.select(doc_id, score.alias("score"), F.length(text).alias("chars")).filter("score > 0").orderBy(F.desc("score"), F.asc("chars"), F.asc(doc_id)).limit(k)


def current_only(chunks: DataFrame, approved: str = "is_approved", status: str = "status", only_current: bool = True) -> DataFrame:
    """Chunks that a search may see: approved (null: not), and the current version unless all are wanted."""
    seen = F.coalesce(F.col(approved), F.lit(False))
    return chunks.filter(seen & (F.col(status) == "current") if only_current else seen)


def greedy_pick(hits: DataFrame, doc_id: str, order: list[Column], keywords: int, per_keyword: int) -> DataFrame:
    """doc_id, ord: each keyword in turn picks its best per_keyword rows among those that no earlier one has picked.

    The fold has one step for each keyword; a step keeps its picks only (per_keyword rows), so the lists it excludes
    stay that small.
    """
    picked = None
    for i in range(1, keywords + 1):
        own = hits.filter(F.col("ord") == i)
        if picked is not None:
            own = own.join(F.broadcast(picked.select(doc_id)), doc_id, "left_anti")  # at most per_keyword rows a step
        own = own.orderBy(*order, F.asc(doc_id)).limit(per_keyword).select(doc_id, "ord")
        picked = own if picked is None else picked.unionByName(own)
    return picked


def dual_quota(chunks: DataFrame, chunk_id: str, title: str, body: str, keywords: list[str], titles: int, bodies: int, domain: Column) -> DataFrame:
    """ord, hit_col, chunk_id, place: for each keyword the first rows with it in the title, and the first with it in the
    body. Those with more keywords in the same column come first, then more in the other, then documents of the domain."""
    in_title, in_body = ([tx.keyword_hit(F.col(c), F.lit(k)) for k in keywords] for c in (title, body))
    ords = lambda hits: F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits, 1)]))
    rows = chunks.select(chunk_id, ords(in_title).alias("t"), ords(in_body).alias("c"), domain.alias("d"))
    ranked = []
    for name, own, other, most in (("title", "t", "c", titles), ("content", "c", "t", bodies)):
        w = W.partitionBy("ord").orderBy(F.size(own).desc(), F.size(other).desc(), F.col("d").desc(), F.col(chunk_id).asc())
        hits = rows.select(chunk_id, "t", "c", "d", F.explode(own).alias("ord"), F.lit(name).alias("hit_col"))
        ranked.append(hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("ord", "hit_col", chunk_id, "place"))
    return ranked[0].unionByName(ranked[1])


def keyword_score(chunk: dict[str, str], keywords: list[str], asked: list[str], synonyms: list[str], stops: list[str], most: int | None = None) -> Column:
    """How well a chunk (columns content, doc_name, article_no) answers keywords, in any case: those that were asked
    weigh 2, others 1, in the content and in the document's name; in the article's title twice that, or 4 for synonyms,
    and nothing for stops. All keywords count; with most, the first so many."""
    has = lambda column, k: F.contains(F.lower(F.coalesce(F.col(chunk[column]), F.lit(""))), F.lit(k.lower())).cast("int")
    known = {x.lower() for x in synonyms}
    score = F.lit(0)
    for k in keywords if most is None else keywords[:most]:
        w = 2 if k in asked else 1
        score = score + w * has("content", k) + w * has("doc_name", k)
        if k not in stops:
            score = score + (4 if k.lower() in known else 2 * w) * has("article_no", k)
    return score


#: The constant of rank fusion, and what an article's kind and a file's name add, in halves of a first place.
RANK_CONSTANT = 60
UNIT = 0.5 / (RANK_CONSTANT + 1)


def kind_bonus(article_no: Column, doc_name: Column) -> Column:
    """Articles gain a unit, addenda and forms lose one, annexes neither; documents that are files lose one more."""
    kind = F.when(article_no.rlike(r"^\d+조"), UNIT).when(article_no.rlike("^(부칙|서식|별지)"), -UNIT).otherwise(0.0)
    return kind - F.when(doc_name.rlike(r"(?i)\.(pdf|md|docx|hwp)$"), UNIT).otherwise(0.0)


def vector_scores(vectors: DataFrame, vec_id: str, embedding: str, query: list[float] | Column) -> DataFrame:
    """All columns and similarity; rows whose vector is null, has no length or another number of components than the query
    are left out. A list is put into the plan as numbers; a column is compared row by row."""
    similar = vx.cosine(F.col(embedding), query) if isinstance(query, Column) else vx.cosine_to(F.col(embedding), query)
    return vectors.withColumn("similarity", similar).filter(F.col("similarity").isNotNull())


def top_similar(scored: DataFrame, vec_id: str, k: int, above: float | None = None) -> DataFrame:
    """The k most similar rows, strictly above the threshold if there is one; exact, no index."""
    kept = scored if above is None else scored.filter(F.col("similarity") > above)
    return kept.orderBy(F.desc("similarity"), F.asc(vec_id)).limit(k)


def two_stage(scored: DataFrame, vec_id: str, k: int, bias: Column, above: float = 0.0) -> DataFrame:
    """A pool of max(30 k, 300) by distance, cut at the threshold on the raw similarity, then the k best by distance
    plus bias."""
    pool = scored.orderBy(F.desc("similarity"), F.asc(vec_id)).limit(max(30 * k, 300)).filter(F.col("similarity") > above)
    return pool.withColumn("adjusted", 1 - F.col("similarity") + bias).orderBy(F.asc("adjusted"), F.asc(vec_id)).limit(k)


def fuse(lists: DataFrame, doc_id: str, group: str, per_group: int | Column, k: int, constant: int = RANK_CONSTANT, bonus: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of rows (list, doc_id, score, group): doc_id, group, fused, place.

    Ranks are within a list by score; at most per_group rows of a group (a number, or a column of the group's own cap) and
    k rows in all are kept. bonus (of the other columns, which belong to the document) is added to each document once.
    """
    ranked = lists.withColumn("r", F.row_number().over(W.partitionBy("list").orderBy(F.desc("score"), F.asc(doc_id))))
    cap = per_group if isinstance(per_group, Column) else F.lit(per_group)
    total = F.sum(F.lit(1.0) / (constant + F.col("r"))) + (F.first(bonus) if bonus is not None else 0.0)
    fused = ranked.groupBy(doc_id, group).agg(F.round(total, 9).alias("fused"), F.first(cap).alias("cap"))
    capped = fused.withColumn("g", F.row_number().over(W.partitionBy(group).orderBy(F.desc("fused"), F.asc(doc_id)))).filter(F.col("g") <= F.col("cap"))
    best = capped.orderBy(F.desc("fused"), F.asc(doc_id)).limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("fused"), F.asc(doc_id)))).select(doc_id, group, "fused", "place")  # k rows


def linear_fusion(semantic: DataFrame, trigram: DataFrame, doc_id: str, k: int) -> DataFrame:
    """doc_id, score = 10 semantic + 5 trigram over a full join, k best."""
    both = semantic.select(doc_id, F.col("score").alias("s")).join(trigram.select(doc_id, F.col("score").alias("t")), doc_id, "full_outer")
    score = F.round(10 * F.coalesce("s", F.lit(0.0)) + 5 * F.coalesce("t", F.lit(0.0)), 9)
    return both.select(doc_id, score.alias("score")).orderBy(F.desc("score"), F.asc(doc_id)).limit(k)


def word_hit(text: Column, word: str) -> Column:
    """A word of Latin letters and digits stands between other characters, in any case; two Hangul syllables count unless
    they stand inside a run, with Hangul on both sides; anything else is a substring, in any case."""
    if re.fullmatch(r"[A-Za-z0-9]+", word):
        return text.rlike(rf"(?i)(^|[^A-Za-z0-9]){word}(?![A-Za-z0-9])")
    if re.fullmatch(r"[가-힣]{2}", word):
        return text.rlike(rf"(?<![가-힣]){word}|{word}(?![가-힣])")
    return F.contains(F.lower(text), F.lit(word.lower()))


def news_rank(news: DataFrame, news_id: str, title: str, body: str, event: str, published: str, words: list[str], k: int = 3, common: int = 10, alike: float = 0.35, hit=word_hit) -> DataFrame:
    """news_id, score, place: the k best news for the words of a question.

    Rows without title or body are left out, and of equal titles one stays (the least id). A word in the title weighs 3
    and in the body 1, both if in both, times its rarity: 2 log10((rows + 1) / (rows with it + 1)), between 0.5 and 2.5.
    A row needs a word in its title, two words in all (unless one is asked for), and evidence: the rarest word in the
    title, or two words there, or a word that stands in fewer than common titles, or three words. A lone word that is
    common finds nothing. The best are taken one after the other, newest first among equals; one that has the event of a
    row taken before, or a title whose character pairs are alike (Jaccard), is passed over.
    """
    usable = news.filter((F.col(title) != "") & (F.col(body) != ""))
    pool = first_per(usable, [title], F.col(news_id).asc())
    t, c = ([hit(F.col(x), w) for w in words] for x in (title, body))
    seen = pool.agg(F.count(F.lit(1)).alias("p"), *[F.count_if(t[i] | c[i]).alias(f"n{i}") for i in range(len(words))], *[F.count_if(t[i]).alias(f"t{i}") for i in range(len(words))]).first()
    if not words or not seen["p"] or (len(words) == 1 and seen["t0"] >= common):
        return news.sparkSession.createDataFrame([], f"{news_id} {dict(news.dtypes)[news_id]}, score double, place int")
    weight = [min(2.5, max(0.5, math.log10((seen["p"] + 1) / (seen[f"n{i}"] + 1)) * 2)) for i in range(len(words))]
    rarest = min(range(len(words)), key=lambda i: seen[f"n{i}"])
    total = lambda cs: sum((x.cast("int") for x in cs), F.lit(0))
    score = sum((weight[i] * (3 * t[i].cast("int") + c[i].cast("int")) for i in range(len(words))), F.lit(0.0))
    in_title, met = total(t), total([a | b for a, b in zip(t, c, strict=True)])
    rare = F.lit(False)
    for i in range(len(words)):
        if seen[f"t{i}"] < common:
            rare = rare | t[i] | c[i]
    good = (in_title >= 1) & (met >= min(2, len(words))) & (t[rarest] | (in_title >= 2) | rare | (met >= 3))
    left = pool.filter(good).select(news_id, F.col(event).alias("event"), F.col(published).alias("at"), F.round(score, 6).alias("score"), F.array_distinct(tx.bigrams(F.regexp_replace(title, r"[^\p{L}\p{N}]", ""))).alias("pairs"))
    left, taken = checkpointed(left), []
    for place in range(1, k + 1):  # k is a handful; each step reads what the filter above has left
        best = left.orderBy(F.desc("score"), F.desc_nulls_last("at"), F.asc(news_id)).first()
        if best is None:
            break
        taken.append((best[news_id], best["score"], place))
        same = F.coalesce(F.col("event") == F.lit(best["event"]), F.lit(False)) & (F.col("event") != "")
        pairs = F.array(*map(F.lit, best["pairs"])).cast("array<string>")
        left = left.filter((F.col(news_id) != best[news_id]) & ~same & (tx.jaccard(F.col("pairs"), pairs) < alike))
    return news.sparkSession.createDataFrame(taken, f"{news_id} {dict(news.dtypes)[news_id]}, score double, place int")


def shared_token_pairs(items: DataFrame, item_id: str, tokens: str, least: int) -> DataFrame:
    """a, b, shared: pairs that share at least least tokens.

    Prefix filtering: tokens are put in order of rarity, and two items that share least tokens must share one of all but
    their least - 1 commonest. So only these meet by token, and candidate pairs are counted on their whole sets.
    """
    own = items.select(F.col(item_id).alias("id"), F.array_distinct(tokens).alias("tokens"))
    df = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = own.select("id", F.explode("tokens").alias("token")).join(df, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    rare = ranked.select("id", F.explode(F.slice("ts", 1, F.greatest(F.lit(0), F.size("ts") - (least - 1)))).alias("t")).select("id", "t.token")
    pairs = rare.alias("x").join(rare.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    sets = lambda n: own.select(F.col("id").alias(n), F.col("tokens").alias(f"{n}_tokens"))
    met = pairs.join(sets("a"), "a").join(sets("b"), "b")
    return met.select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long").alias("shared")).filter(F.col("shared") >= least)


def containment(sources: DataFrame, source_id: str, targets: DataFrame, target_id: str, text: str, n: int = 6, stride: int = 7, least: float = 0.15) -> DataFrame:
    """target, source, ratio, back_ratio: pairs of which each side's n-grams stand in the other's text.

    ratio is the share of the source's distinct n-grams, at every stride characters of its squeezed text, that the target
    has anywhere; back_ratio is the same the other way round. Both are at least least. Texts shorter than n have none.

    A target's n-grams are distinct before they leave its row and meet the sources' probes by equality: a hash join that
    the optimizer broadcasts where the sources are few, and a shuffle where they are many. The way back is only looked at
    for pairs that the way forth has left.
    """
    ship_package(targets.sparkSession)
    squeezed = tx.squeezed(F.lower(text))
    own = gram_rows(sources.select(F.col(source_id).alias("source"), squeezed), n, probes=stride, grams=1)
    own = checkpointed(own.filter(F.size("probes") > 0))
    probes = own.select("source", F.size("probes").alias("n_probes"), F.explode("probes").alias("gram"))
    texts = targets.select(F.col(target_id).alias("target"), squeezed.alias("squeezed"))
    held = gram_rows(texts, n, grams=1).select("target", F.explode("grams").alias("gram"))
    forth = held.join(probes, "gram").groupBy("target", "source").agg(F.round(F.count(F.lit(1)) / F.first("n_probes"), 6).alias("ratio"))
    forth = checkpointed(forth.filter(F.col("ratio") >= least))
    back = gram_rows(texts.join(forth.select("target").distinct(), "target", "left_semi"), n, back=stride)
    pairs = forth.join(back, "target").join(own.select("source", "grams"), "source")
    ratio = F.round(F.size(F.array_intersect("back", "grams")) / F.size("back"), 6)
    return pairs.withColumn("back_ratio", ratio).filter(F.col("back_ratio") >= least).select("target", "source", "ratio", "back_ratio")


def verbatim_share(answer: Column, source: Column, window: int = 18, step: int = 8) -> Column:
    """The share of the answer's windows that stand in the source; short answers count as one window."""
    a, s = tx.squeezed(answer), tx.squeezed(source)
    starts = F.when(F.length(a) > window, F.sequence(F.lit(1), F.length(a) - window + 1, F.lit(step))).otherwise(F.array(F.lit(1)))
    hits = F.size(F.filter(starts, lambda i: F.contains(s, F.substr(a, i, F.lit(window)))))
    return F.when(F.length(a) >= 12, F.round(hits / F.size(starts), 6))


def article_rank(hits: DataFrame, doc_name: str, article_no: str, act: str, topics: list[str], domain: Column, tier: Column, k: int = 5) -> DataFrame:
    """doc_name, article_no, score, place: the k best articles, one row each.

    The score is twice the weight of the act that hit the title, plus the longest stretch of a topic that the document's
    name or the title has (four characters at least; topics of up to three characters count as a whole), plus 1 in the
    domain. Then the higher tier of law, the name and the article decide.
    """
    hay = F.concat(F.col(doc_name), F.lit(" "), F.coalesce(F.col(article_no), F.lit("")))
    best = [F.when(F.contains(hay, F.lit(t)), len(t)).otherwise(0) if len(t) <= 3 else tx.longest_common(F.lit(t), hay) for t in topics]
    longest = F.greatest(F.lit(0), F.lit(0), *[F.when(b >= 4, b).otherwise(0) if len(t) > 3 else b for t, b in zip(topics, best, strict=True)])
    rows = hits.select(doc_name, F.coalesce(F.col(article_no), F.lit("")).alias(article_no), (2 * F.col(act) + longest + domain.cast("int")).cast("int").alias("score"), tier.alias("_tier"))
    order = [F.desc("score"), F.desc("_tier"), F.asc(doc_name), F.asc(article_no)]
    one = first_per(rows, [doc_name, article_no], *order).orderBy(*order).limit(k)
    return one.withColumn("place", F.row_number().over(W.orderBy(*order))).select(doc_name, article_no, "score", "place")  # k rows


def expanded(questions: DataFrame, question_id: str, text: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """question_id, words (what the synonyms add, each word once, in the order of the table) and expanded (the question
    with these words behind it). The table is a dictionary that people keep; it goes into the plan."""
    added = F.flatten(F.array(*[F.when(F.contains(F.col(text), F.lit(k)), F.array(*map(F.lit, ws))).otherwise(F.array().cast("array<string>")) for k, ws in synonyms.items()]))
    words = F.array_distinct(added)
    return questions.select(question_id, words.alias("words"), F.when(F.size(words) > 0, F.concat_ws(" ", F.col(text), F.array_join(words, " "))).otherwise(F.col(text)).alias("expanded"))


def within_budget(items: DataFrame, question: str, section: str, place: str, chars: Column, other_chars: Column, cap: int, drop_order: list[str]) -> DataFrame:
    """The items of a question's context that fit: while the other text and the items together exceed cap, one item goes,
    from the first section of drop_order that has one left, from its end. Items of sections not named there stay.

    An item goes exactly if what is left before it, in the order of dropping, is still too much: a running sum, no loop.
    """
    rank = F.coalesce(*[F.when(F.col(section) == s, F.lit(i)) for i, s in enumerate(drop_order)])
    rows = items.withColumns({"_c": chars, "_rank": rank})
    all_chars = F.sum("_c").over(W.partitionBy(question))
    gone = W.partitionBy(question).orderBy(F.col("_rank").asc_nulls_last(), F.col(place).desc()).rowsBetween(W.unboundedPreceding, -1)
    over = other_chars + all_chars - F.coalesce(F.sum("_c").over(gone), F.lit(0)) > cap
    return rows.withColumn("_over", over).filter(F.col("_rank").isNull() | ~F.col("_over")).drop("_c", "_rank", "_over")


def until_short_page(pages: DataFrame, feed: str, page: str, rows: str, size: int) -> DataFrame:
    """The pages of a feed that a reader asks for: up to the first one that is not full, or that is missing."""
    w = W.partitionBy(feed).orderBy(page)
    out = pages.withColumn("_stop", F.coalesce(F.max((F.col(rows) < size).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("_gap", F.col(page) - F.row_number().over(w) != F.min(page).over(W.partitionBy(feed)) - 1)
    return out.filter((F.col("_stop") == 0) & ~F.col("_gap")).drop("_stop", "_gap")
