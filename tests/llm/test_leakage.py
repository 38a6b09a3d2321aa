import random
import unicodedata

from paneloom.llm import leakage as L

RNG = random.Random(8)
VOCAB = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]


def some(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def altered(words, every):
    return [("changed" if i % every == every - 1 else w) for i, w in enumerate(words)]


def test_cases(spark):
    item, other = some(100), some(80)
    zh = [chr(0x4E00 + RNG.randrange(3000)) for _ in range(120)]
    text = lambda w: " ".join(w)
    docs = {
        1: text(some(300) + item + some(300)),
        2: text(some(50) + altered(item, 9) + some(20)).upper(),
        3: text(some(50) + item[:30] + some(60) + item[50:72]),  # two passages, 52 words
        4: text(some(50) + item[:35] + some(60)),  # too little
        5: text(w for pair in zip(*[iter(item)] * 8) for w in [*pair, *some(20)]),  # quotations of eight words
        6: text(sorted(item)),
        7: None, 8: "", 9: "，".join(zh[:60]) + "\r\n> ", 10: "".join(zh[:40]), 11: text(some(9000) + item[20:80]), 12: text(item) + text(other),
        13: text(item).replace(" ", "​, "), 14: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in text(item)),
    }
    items = [(1, text(item), "q"), (2, text(other), "q"), (3, "".join(zh), "q"), (4, None, "q"), (5, "short one", "q")]
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked(d.drop("item_id"), i, "doc_id", "item_id").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 3), (11, 1), (12, 1), (12, 2), (13, 1), (14, 1)}
    left = L.without_leaks(d, L.leaked(d, i))
    assert {r["doc_id"] for r in left.collect()} == {4, 5, 6, 7, 8, 10}
    assert L.leaked(d.limit(0), i).count() == 0 and L.leaked(d, i.limit(0)).count() == 0


def test_spans_are_cut_out(spark):
    item, before, after = some(60), some(30), some(25)
    odd = " ".join(before) + ", ｗｉｄｅ é e\u0301: " + "\u200b; ".join(item[:40]) + "! " + " ".join(after)
    d = spark.createDataFrame([(1, odd), (2, " ".join(after)), (3, None), (4, "")], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:30] + some(10)))], "item_id long, text string")
    found = L.leaked(d, i)
    assert found.count() == 2  # both items hold the passage or a part of it
    out = {r["doc_id"]: r for r in L.without_spans(d, found).collect()}
    assert out[1]["text"] == " ".join(before) + ", ｗｉｄｅ é e\u0301: " + "! " + " ".join(after)
    assert out[1]["words_cut"] >= 40 and (out[2]["text"], out[3]["text"], out[4]["text"]) == (" ".join(after), None, "")
    assert L.leaked(d.select("doc_id", "text").join(spark.createDataFrame([], "doc_id long"), "doc_id"), i).count() == 0


def test_short_items_stand_whole(spark):
    item = some(5)
    d = spark.createDataFrame([(1, " ".join(some(20) + item + some(3))), (2, " ".join(item[:4])), (3, " ".join(item[:3]))], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(some(40)))], "item_id long, text string")
    assert L.leaked(d, i).count() == 0
    assert [(r["doc_id"], r["item_id"], r["share"]) for r in L.leaked(d, i, short=True).collect()] == [(1, 1, 1.0)]


def brute(words, item):
    """Share of the item in common runs of at least PASSAGE words, by longest common substrings."""
    covered = set()
    for a in range(len(item)):
        for b in range(len(words)):
            n = 0
            while a + n < len(item) and b + n < len(words) and item[a + n] == words[b + n]:
                n += 1
            if n >= L.PASSAGE:
                covered |= set(range(a, a + n))
    return len(covered) / len(item)


def test_shares_against_brute_force():
    item = some(60)
    tests = L.TestItems([(1, item)])
    for n in range(0, 61, 6):
        doc = some(40) + item[:n] + some(15)
        found = [(i, s) for _, i, s, _ in L._found(tests, [" ".join(doc)])]
        want = brute(doc, item)
        assert bool(found) == (want >= L.SHARE)
        if found:
            assert abs(found[0][1] - want) <= 2 / 60


def test_words():
    assert L.words("Ｆｕｌｌ-width, it's 3.5 漢字!") == ["full", "width", "it", "s", "3", "5", "漢", "字"]
    assert L.words(None) == [] and unicodedata.normalize("NFKC", "①") == "1"
