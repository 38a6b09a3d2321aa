import random
import zlib

import numpy as np
import pyarrow as pa

from paneloom.llm import subjects as S

TERMS = {
    "tax": ["levy", "refund", "excise", "tariff", "duty", "rebate"], "sea": ["tide", "reef", "harbour", "sail", "anchor", "keel"], "farm": ["barley", "plough", "orchard", "silo", "tractor", "meadow"],
    "music": ["sonata", "violin", "chord", "opera", "tempo", "cello"], "law": ["statute", "verdict", "appeal", "counsel", "tribunal", "plea"],
}
NAMES = sorted(TERMS)
FILL = ["morning", "report", "table", "figure", "later", "again", "second", "office", "window", "people"]


def sentence(rng, subject):
    own = rng.sample(TERMS[subject], 3) if subject else []
    return " ".join(rng.sample(own + rng.sample(FILL, 4), len(own) + 4)).capitalize() + ". "


def corpus(rng, n):
    rows, truth = [], {}
    for i in range(n):
        if i % 10 == 9:
            rows.append((i, rng.choice([None, "", "  ", "123 456", "".join(sentence(rng, None) for _ in range(6))])))
            truth[i] = set()
            continue
        subjects = rng.sample(NAMES, 1 if i % 3 else 2)
        rows.append((i, "".join(sentence(rng, rng.choice(subjects) if len(subjects) == 1 else subjects[k % 2]) + (sentence(rng, None) if rng.random() < 0.4 else "") for k in range(8))))
        truth[i] = set(subjects)
    return rows, truth


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows, truth = corpus(rng, 400)
    labels = [(i, s, "a") for i in range(0, 90) for s in sorted(truth[i])]
    labels += [(1, "nothing", "b"), (2, None, "b"), (None, "tax", "b")] + labels[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as subject")
    found = S.document_subjects(docs, spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), [(n, f"{TERMS[n][0]} and {TERMS[n][1]}.") for n in NAMES])
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == truth[i] for i in truth)
    assert right / len(truth) > 0.95
    made = S.composition(found, docs.selectExpr("doc_id", "length(text) as n_chars", "'en' as lang"), ["lang"]).collect()
    assert sum(r["documents"] for r in made) >= 400


def found_of(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.document_subjects(docs, spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), [(n, f"{TERMS[n][0]} and {TERMS[n][1]}.") for n in NAMES])
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    return got


def test_a_subject_that_holds_half_of_the_rows(spark):
    """Its words are as common as copies make them; the original documents keep their subjects."""
    rng = random.Random(5)
    rows, truth = corpus(rng, 300)
    labels = [(i, s, "a") for i in range(0, 90) for s in sorted(truth[i])]
    tax = [t for i, t in rows if "tax" in truth[i]]
    rows += [(1000 + i, tax[i % len(tax)]) for i in range(300)]
    got = found_of(spark, rows, labels)
    assert sum(got.get(i, set()) == truth[i] for i in truth) / len(truth) > 0.95


def test_a_subject_of_few_documents(spark):
    """Six documents of a subject among 1,500: none of its words stands in a thousandth of the sentences."""
    rng = random.Random(7)
    rows, truth = corpus(rng, 1500)
    few = sorted(i for i in truth if truth[i] == {"tax"})[:4] + sorted(i for i in truth if truth[i] >= {"tax", "sea"})[:2]
    rows = [(i, t) for i, t in rows if "tax" not in truth[i] or i in few]
    labels = [(i, s, "a") for i, _ in rows if i < 200 or i in few[:2] for s in sorted(truth[i])]
    got = found_of(spark, rows, labels)
    assert all("tax" in got.get(i, set()) for i in few)
    assert sum("tax" in s for i, s in got.items() if i not in few) < 3


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, "Some words here.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    assert S.document_subjects(docs.limit(0), none, [("tax", "levy"), ("sea", "tide")]).count() == 0
    assert S.document_subjects(docs, none, [("tax", "levy"), ("sea", "tide")]).count() == 0


def test_phrases_by_hand():
    ids = S._Ids()
    doc, sent, _ = S.sentence_phrases(["One two. three 3.5 four!", None, "", "中文字符 ab(c) x_y", "中文"], ids)
    assert doc.tolist() == [0, 0, 0, 0, 3, 3] and len(set(sent.tolist())) == 3


def test_identifiers_end_where_they_end():
    doc, sent, phrase = S.sentence_phrases(["用zscore(rank(close))。后面的文字还在", "pe_ttm为负的公司", "We take rank(close). Then more words"], S._Ids())
    assert [(doc == i).sum() for i in range(3)] == [5, 3, 5]
    assert [len(set(sent[doc == i].tolist())) for i in range(3)] == [1, 1, 2]
    assert not set(phrase.tolist()) & set(S.sentence_phrases(["rank close zscore pe ttm"], S._Ids())[2].tolist())


def test_small_talk_has_no_subject(spark):
    """Sentences that recur word for word, and a document of small talk that mentions a subject once."""
    rng = random.Random(11)
    rows, truth = corpus(rng, 400)
    talk = ["The lamp by the stairs is on. ", "Lunch came late again today. ", "Nobody watered those plants. ", "We all meet on Thursday. "]
    rows = [(i, t and t + rng.choice(talk)) for i, t in rows]
    rows += [(1000 + i, "".join(rng.choice(talk) for _ in range(9)) + (sentence(rng, "tax") if i % 2 else "")) for i in range(80)]
    labels = [(i, s, "a") for i in range(0, 90) for s in sorted(truth[i])]
    got = found_of(spark, rows, labels)
    assert not any(i >= 1000 for i in got)
    assert sum(got.get(i, set()) == truth[i] for i in truth) / len(truth) > 0.95


def blocked(spark, seeds):
    """A block of three documents of the subjects 0 and 1, by two phrases each, with votes."""
    texts = ["levy excise one. levy excise two. levy excise three. tide reef four", "tide reef. tide reef", "levy excise"]
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts, seeds))]
    batch = S._blocks(spark.createDataFrame(rows, "doc_id long, text string, seed long").coalesce(1), "doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    words = {zlib.crc32(w.encode()): j for w, j in (("levy", 0), ("excise", 0), ("tide", 1), ("reef", 1))}
    own = [(p, words[x]) for p, x in enumerate(batch.column("phrases")[0].as_py()) if x in words]
    cast = [[{"place": p, "vote": np.eye(2, dtype=np.float32)[j].tobytes()} for p, j in own]]
    votes = pa.array(cast, pa.list_(pa.struct([("place", pa.int32()), ("vote", pa.binary())])))
    return S._Block(pa.RecordBatch.from_arrays([*batch.columns, votes], names=[*batch.schema.names, "votes"]), 0, 2)


def test_seeds_are_clamped_where_their_sentences_bear_them_out(spark):
    free, right, wrong = (blocked(spark, s).labels().argmax(1) - (blocked(spark, s).labels().sum(1) == 0) * 9 for s in ([0, 0, 0], [1, 2, 0], [2, 0, 0]))
    assert free.tolist() == [0, 0, 0, 1, 1, 1, 0]
    assert right.tolist() == [0, 0, 0, -9, 1, 1, 0]  # a mention of another subject in a trusted seed is no evidence
    assert wrong.tolist() == free.tolist()  # a label that three of four sentences speak against clamps nothing


def test_copies_of_a_sentence_count_once(spark):
    b = blocked(spark, [0, 0, 0])
    seen = dict(zip(b.phrases.tolist(), (int(x).bit_count() for x in b.seen().view(np.uint64))))
    # of levy: "levy excise one", "... two", "... three" and "levy excise"; of tide: "tide reef four" and twice "tide reef"
    assert seen[zlib.crc32(b"levy")] == 4 and seen[zlib.crc32(b"tide")] == 2
