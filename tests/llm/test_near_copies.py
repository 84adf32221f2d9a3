"""Line dedup keeps the bodies of near copies, and still drops what recurs in texts that are otherwise unlike."""

import random

from corpusloom.llm import linededup


def test_near_copies_keep_their_body(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = lambda n: " ".join(word() for _ in range(n))
    body, second = own(93).split(" "), own(30)
    footer = "All rights to this text stay with the press office"
    rows = []
    for i in range(40):
        copy = list(body)
        copy[10 + 2 * i] = word()  # one other word in each copy
        rows.append((i, "\n".join([" ".join(copy), second, own(4)])))
    rows += [(100 + i, "\n".join([own(30), own(25), footer])) for i in range(10)]
    rows += [(200 + i, "\n".join([own(30), own(25), "Only nine texts that are unlike have this"])) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.drop_recurring_lines(docs).collect()}
    for i, text in rows:
        want = text.removesuffix("\n" + footer)
        assert (got[i]["text"], got[i]["n_dropped"]) == (want, int(want != text)), i


def test_what_goes_does_not_hang_on_the_size_of_the_corpus(spark):
    """The same texts, repeated in other words: leaves grow busy (leading words and lengths are common), lines stay unlike."""
    rng = random.Random(6)
    lead = ["so it was", "and then the", "if all of"]
    plan = [[(rng.choice(lead), rng.randrange(6, 9)) for _ in range(5)] for _ in range(30)]
    footer = ["the whole of this stands at the foot of very many pages of ours", "and then the same again"]

    def corpus(times):
        rows = []
        for t in range(times):
            own = random.Random(100 + t)
            for i, lines in enumerate(plan):
                body = [f"{a} " + " ".join(f"{own.choice('abcdefgh')}{own.choice('klmnop')}{own.choice('uvwx')}x{chr(97 + t % 26)}{chr(97 + t // 26)}" for _ in range(n)) for a, n in lines]
                rows.append((t * 1000 + i, "\n".join([*body, *(footer if t == 0 and i < 12 else [])])))
        return spark.createDataFrame(rows, "doc_id long, text string")

    got = [{(r["doc_id"], r["text"]) for r in linededup.drop_recurring_lines(corpus(n)).filter("doc_id < 1000 and n_dropped > 0").select("doc_id", "text").collect()} for n in (1, 30)]
    assert got[0] == got[1] and len(got[0]) == 12


def test_texts_that_share_one_long_footer_are_not_near_copies(spark):
    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    footer = own(40)
    shared = [own(30) for _ in range(5)]
    rows = [(10 * g + i, "\n".join([shared[g], footer, own(2)])) for g in range(5) for i in range(4)]
    got = linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(footer not in r["text"] and any(s in r["text"] for s in shared) for r in got)
