"""The pipeline stage by stage against plain versions, over odd rows and planted ones."""

import collections
import zlib

import numpy as np
import pytest
from test_operators import LOWER, brute_components

import corpus_pipeline
from codegov.llm import quality, toxicity
from codegov.llm.vocab import default_path

SCHEMA = "doc_id long, text string, lang string, source string, score double, predicted int"
LINE = "This notice stands below every page of the site."


def planted():
    """(rows, labels): clean, toxic and junk documents, a line in many of them, near and exact copies, odd rows."""
    r = np.random.default_rng(8)
    plain = [f"w{k}a" for k in range(300)]
    rows, marks = [], []
    for i in range(300):
        t, bad, junk = list(r.choice(plain, 80)), i % 5 == 0, i % 7 == 0
        if bad:
            for k in r.integers(0, 80, 6):
                t[k] = str(r.choice(["zorkish", "zorkly", "blamper"]))
        text = " ".join(t).upper() + " ### $$$ !!" * 12 if junk else " ".join(t)
        rows.append((i, f"{text}\n  {LINE.upper() if i % 2 else LINE} \nlast {i}" if i % 3 == 0 else text))
        marks.append((i, int(not junk), int(bad)))
    clean = [rows[i] for i in range(300) if i % 5 and i % 7 and i % 3]
    for k, (i, text) in enumerate(clean[:20]):
        copy = text.split(" ")
        copy[40] = "changed"
        rows.append((1000 + k, " ".join(copy) if k % 2 else text))
    rows += [(2000, ""), (2001, None), (2002, " \n\t "), (2003, clean[30][1] + " and" * 30_000), (None, clean[31][1] + " no id"), (None, None), clean[32], (2004, clean[33][1] + " one text"), (2004, " ".join(reversed(clean[34][1].split(" ")))), (2005, f"{LINE}\n{LINE}")]
    return [(i, t, "en", f"s{k % 3}", 0.5, 1) for k, (i, t) in enumerate(rows)], marks


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(folder, rows before and after each stage)."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, marks = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{k}")
        out = spark.read.parquet(f"{folder}/stage{k}")
        assert k == 4 or out.columns == names
        found.append((docs, out))
        docs = out
    return folder, found


def multiset(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize(("k", "scored", "kept", "truth"), [(0, toxicity.score, 0, lambda i: i % 5 != 0), (1, quality.score, 1, lambda i: i % 7 != 0)])
def test_classifier_stages_keep_what_their_scores_say(spark, stages, k, scored, kept, truth):
    folder, found = stages
    before, after = found[k]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    marks = scored(before.drop("score", "predicted"), labels)
    want = collections.Counter((r.doc_id, r.text) for r in marks.where(f"predicted = {kept}").collect())
    assert collections.Counter((r.doc_id, r.text) for r in after.collect()) == want and not multiset(after) - multiset(before)
    ids = {r.doc_id for r in after.collect()}
    asked = [r.doc_id for r in before.where("doc_id < 300").collect()]
    assert np.mean([(i in ids) == truth(i) for i in asked]) > 0.97
    assert ids >= {i for i in range(1000, 1020)}  # clean copies stay


def test_line_stage_equals_a_plain_version(stages):
    before, after = stages[1][2]
    rows = before.collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            for line in (r.text or "").split("\n"):
                holders[key(line)].add(r.doc_id)
    lost = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    assert lost
    want = collections.Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        keep = lines if r.doc_id is None else [x for x in lines if key(x) not in lost or lost[key(x)] == r.doc_id]
        want[(r.doc_id, "\n".join(keep))] += 1
    assert collections.Counter((r.doc_id, r.text or "") for r in after.collect()) == want


def test_join_stage_keeps_one_of_each_group(stages):
    before, after = stages[1][3]
    rows = before.collect()
    nodes = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=lambda x: (x[0], x[1] or ""))
    homes = brute_components({k: t for k, (_, t) in enumerate(nodes)}, 5, 80, 100)
    want = collections.Counter((i, t) for k, (i, t) in enumerate(nodes) if homes[k] == k)
    want.update((r.doc_id, r.text) for r in rows if r.doc_id is None)
    assert collections.Counter((r.doc_id, r.text) for r in after.collect()) == want
    assert len(want) < len(rows)


def test_packing_stage_holds_every_id_once(spark, stages):
    import tokenizers

    folder, found = stages
    before, after = found[4]
    whole = tokenizers.Tokenizer.from_file(default_path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    filled = collections.defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        filled[r.sequence_id].append((r.offset, r.length))
    for s in filled.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    texts = collections.defaultdict(list)
    for r in before.collect():
        texts[r.doc_id].append([*whole.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert set(pieces) == set(texts)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, held in texts.items():
        assert sum(n for _, n, _, _ in pieces[i]) == sum(map(len, held))
        for start, length, check, total in pieces[i]:
            assert any(len(ids) == total and crc(ids[start : start + length]) == check for ids in held)
    again = corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert multiset(again) == multiset(after.select(*again.columns))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
