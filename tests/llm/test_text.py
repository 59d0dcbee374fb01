"""WARC conversion, toxicity, decontamination, language ID and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import arc, decontamination, langid, toxicity
from quarry.llm.queries import table
from tests.conftest import SF

PAGES = "page_id long, url string, html string, digest string, key long, revisit boolean"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [("http://a b/ü?q=1", b"x\r\n\r\ny\n\n"), ("", b""), ("http://c", b"\n" * 5)]
    raw = arc.arc_head(version, "n") + b"".join(arc.arc_record(version, u, p, 0, "n") for u, p in bodies)
    got = list(arc.arc_records(raw))
    assert [arc.http_parts(b)[1] for _, b in got] == [p for _, p in bodies]
    assert list(got[0][0]) == list(arc.FIELDS[version]) and len(got[0][0]["URL"].split()) == 1
    with pytest.raises(ValueError):
        list(arc.arc_records(raw[:-6]))
    record = arc.warc_record(got[0][0], got[0][1], 7, None, False)
    (headers, content), = arc.warc_records(io.BytesIO(record))
    assert headers["WARC-Date"] == "2024-01-01T00:00:00Z" and headers["WARC-Payload-Digest"] == "sha1:" + arc.sha1_base32(bodies[0][1]) and content == got[0][1]
    assert record == arc.warc_record(got[0][0], got[0][1], 7, None, False)
    (again, head), = arc.warc_records(io.BytesIO(arc.warc_record(got[0][0], got[0][1], 5, 7, True)))
    assert again["WARC-Refers-To"] == headers["WARC-Record-ID"] != again["WARC-Record-ID"] and head and len(head) < len(content)
    (opening, fields), = arc.warc_records(io.BytesIO(arc.warcinfo_record("n")))
    assert opening["WARC-Type"] == "warcinfo" and b"isPartOf: n" in fields
    assert list(arc.warc_records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(record) * 3))))[2][1] == content


@pytest.mark.parametrize(("version", "least"), [(2, 0), (1, 5)])
def test_archives(spark, version, least):
    rows = [(1, "u1", "same"), (2, "u 2", "same"), (9, None, "same"), (3, "u3", None), (4, "u4", ""), (5, "u5", "x" * 200_000), (6, "u6", "other text"), (7, "u7", "other text"), (None, "u8", "other text"), (6, "u6", "other text")]
    pages = spark.createDataFrame([(*r, "d", 1, None) for r in rows], PAGES)
    got = arc.read_archives(spark, *arc.write_archives(pages, version=version, least_bytes=least)).collect()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        best = max(x for x in groups[h or ""] if x is not None)
        revisit = len(raw) >= least and i != best
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", str(best if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert arc.read_archives(spark, *arc.write_archives(pages.limit(0))).count() == 0


def test_maximal_segments():
    def slow(scores):
        """By definition: the best subsequence (ties: the shortest), then the same on both sides of it."""
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return [*slow(scores[:i]), (i, j), *((a + j, b + j) for a, b in slow(scores[j:]))]

    rng = np.random.default_rng(4)
    for n in [0, 1, *rng.integers(2, 16, 300)]:
        scores = np.round(rng.normal(-0.2, 1, n), 3)
        assert [(s.start, s.end) for s in toxicity.maximal_segments(scores)] == slow(scores.tolist())
    assert len(toxicity.maximal_segments(np.where(np.arange(200_000) % 2, 1.0, -1.1))) == 100_000


def test_extreme_rate():
    rate = toxicity.extreme_rate(np.array([1.0, -1.0]), np.array([0.25, 0.75]))
    assert abs(rate - np.log(3)) < 1e-9


def test_toxicity(spark, odd, none):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == t for p, t in held]) > 0.9
    model = toxicity.learned(docs, labels)
    assert toxicity.toxic_passages(model, "you stupid worthless idiot, pathetic moron and disgusting trash scum") and not toxicity.toxic_passages(model, "the and of")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert {r.score < 0.001 for r in toxicity.toxicity(odd, labels.where("toxic = 0")).collect()} == {True}
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0


def test_scores_equal_brute_force(spark):
    """Short texts' scores by the definitions: tokens' odds (those of all rarer ones for what the model lacks), drift, segments by search, their surprise and evidence."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.learned(docs, labels)

    def slow(scores):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        i, j = best[3:]
        return [*slow(scores[:i]), best[0], *slow(scores[j:])]

    worst, rest = sorted(model.scores, key=model.scores.get)[-8:], model.scores.get(toxicity.REST, 0.0)
    rng, texts = random.Random(9), ["", " \n", "..."]
    own = [r.text.split() for r in docs.orderBy("doc_id").limit(60).collect()]
    for w in own:
        picked = w[: rng.randrange(1, 25)]
        for _ in range(rng.randrange(4)):
            picked.insert(rng.randrange(len(picked) + 1), rng.choice([x for x in worst if not x.startswith(b"^")] or [b"x"]).decode())
        texts.append(" ".join(picked))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in made.select("doc_id", "text").mapInArrow(toxicity._features(model), "doc_id long, n long, surprise double, evidence double").collect()}
    some = 0
    for i, text in enumerate(texts):
        words, scores = toxicity.words(text), []
        for k, w in enumerate(words):
            stem = w.decode()[: toxicity.STEM].encode()
            best = max([model.scores.get(w, rest)] + ([model.scores.get(b"^" + stem, rest)] if len(stem) < len(w) else []))
            scores.append(min(best, 0.0) - model.drift if k and words[k - 1] == w else best - model.drift)
        surprise = [model.rate * s - np.log(max(model.k * len(words), 1e-300)) for s in slow(scores)]
        evidence = sum(s + np.log(toxicity.SIGNIFICANT) for s in surprise if s > -np.log(toxicity.SIGNIFICANT))
        assert got[i].n == len(words) and abs(got[i].surprise - max([0.0, *surprise])) < 1e-6 and abs(got[i].evidence - evidence) < 1e-6, text
        some += evidence > 0
    assert some > 5


def edited(text, edits, rng, vocabulary):
    out = text.split()
    for _ in range(edits):
        i, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.5:
            out[i] = rng.choice(vocabulary)
        elif kind < 0.75 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, rng.choice(vocabulary))
    return " ".join(out)


def slow_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edit_verification():
    rng = random.Random(6)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        got = decontamination.edits_within(np.array(item, np.int32), np.array(text, np.int32), 9)[0]
        assert got == slow_edits(item, text)


def test_recall_at_the_limit(spark):
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    rng, index = random.Random(7), decontamination.Index(items)
    vocabulary = [w for _, t in items for w in t.split()]
    for share, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 0.95)):
        made, want = [], []
        for _ in range(300):
            item_id, text = rng.choice(items)
            at = rng.randrange(len(vocabulary) - 60)
            made.append(" ".join([*vocabulary[at : at + 25], edited(text, int(share * len(decontamination.words(text))), rng, vocabulary), *vocabulary[at + 25 : at + 50]]))
            want.append(item_id)
        found = [i in {h[0] for h in hits} for i, hits in zip(want, index.hits(made), strict=True)]
        assert np.mean(found) >= least, share


@pytest.mark.parametrize("n", [8, 27, 40, 60, 89, 90, 150, 250, 400])
def test_recall_of_every_length(n):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i in range(120)]
    made = [" ".join([*rng.choices(vocabulary, k=40), edited(text, int(0.2 * n), rng, vocabulary), *rng.choices(vocabulary, k=40)]) for _, text in items]
    found = [i in {h[0] for h in hits} for (i, _), hits in zip(items, decontamination.Index(items).hits(made), strict=True)]
    assert np.mean(found) >= 0.95


def test_contaminated_equals_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(docs, items).collect()}
    listed = [(r.item_id, decontamination.words(r.text)) for r in items.collect()]
    want = {}
    for d in docs.collect():
        own = decontamination.words(d.text)
        shingles = {tuple(own[i : i + 3]) for i in range(len(own) - 2)}
        for item_id, words in listed:
            # at 0.8 of the words, some three of them in a row are untouched
            if any(tuple(words[i : i + 3]) in shingles for i in range(len(words) - 2)) and (n := slow_edits(words, own)) <= 0.2 * len(words):
                want[d.doc_id, item_id] = n
    assert want and set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_blocks_of_items(spark):
    """Several blocks give what one gives."""
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    made = decontamination.blocks(items, 16, 0.8, size=11)
    assert len(made) > 2 and sorted(x for b in made for x in b.items()) == sorted(map(tuple, items.collect()))
    whole, parts = ([h for d in docs.collect() for index in indexes for h in index.hits([d.text])[0]] for indexes in ([decontamination.Index(sorted(map(tuple, items.collect())))], [b.index() for b in made]))
    assert len(whole) and abs(len(whole) - len(parts)) <= 0.05 * len(whole)


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "on the mat and looked at the dog"), (2, None), (3, ""), (None, "x y"), (4, "sat on")], "item_id long, text string")
    hit = decontamination.contaminated(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in hit} == {(d, i) for d in (0, 1, 11) for i in (1, 4)}
    assert len([r for r in hit if r.doc_id == 0 and r.item_id == 1]) == 2
    clean = decontamination.decontaminate(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4
    assert decontamination.contaminated(none, items).count() == 0 and decontamination.contaminated(odd, items.limit(0)).count() == 0


def test_gradients_by_differences():
    model = langid.new_model(["a", "b", "c"], 5)
    for k in model.weights:
        model.weights[k] = model.weights[k].astype("f8")
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (7, 4)), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(model, x, y)
    for k, w in model.weights.items():
        at = (1, int(x[3, 1])) if k[0] == "E" else tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-5
        up = langid.gradients(model, x, y)[0]
        w[at] -= 2e-5
        down = langid.gradients(model, x, y)[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6


def test_labels_equal_brute_force(spark):
    """predict() against the network's equations, position by position."""
    model = langid.new_model(["de", "en", "fr"], 4, seed=3)
    w = {k: v.astype("f8") for k, v in model.weights.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(E, U, raw):
        h, out = np.zeros(4), []
        for b in raw:
            u, e = U @ h, E[:, b]
            r, z = sigmoid(e[:4] + u[:4]), sigmoid(e[4:8] + u[4:8])
            n = np.tanh(e[8:] + r * u[8:])
            h = n + z * (h - n)
            out.append(h)
        return out

    rng, texts = random.Random(2), ["a", "ab é", "日本", "x" * 127, "y z" * 43, "", None, "12 34"]
    texts += ["".join(rng.choice("abcdé ñ日") for _ in range(rng.randrange(1, 400))) for _ in range(12)]
    want = []
    for text in texts:
        raw, rows = (text or "").encode(), []
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, raw[-1:])  # the last byte stands behind the end
            ahead, back = run(w["Ef"], w["Uf"], part), run(w["Eb"], w["Ub"], part[::-1])[::-1]
            for i in range(min(langid.WINDOW, len(raw) - at)):
                x = np.exp(w["W"] @ np.concatenate([ahead[i], back[i]]) + w["c"][:, 0])
                rows.append(x / x.sum())
        p = np.mean(rows, 0) if rows else np.zeros(3)
        known = any(c.isalpha() for c in text or "")
        want.append((model.languages[int(p.argmax())] if known else "und", float(p.max()) if known else 0.0))
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [x for x, _ in want] and np.allclose([r.score for r in got], [y for _, y in want], atol=1e-5)


def test_windows_cover_every_byte():
    model = langid.new_model(["a", "b"], 4)
    raw = [b"x" * n for n in (0, 1, 127, 128, 129, 1000)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    p = langid.document_probabilities(model, np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert np.allclose(p[1:].sum(1), 1) and p[0].sum() == 0


def test_language_id(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and np.mean([a == b for a, b in held]) > 0.95
    rows = langid.language_id(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 10)} == {"und"} and {r.score for r in rows if r.doc_id in (2, 3)} == {0.0}
    assert {r.lang_pred for r in rows} <= {"und", "en", "fr"}
    assert {r.lang_pred for r in langid.language_id(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}
    assert langid.language_id(none).count() == 0
    kept = langid.keep_identified(odd, langid.learned(docs))
    assert kept.columns == odd.columns and not {2, 3, 4, 10} & {r.doc_id for r in kept.collect()}


def test_texts_of_no_clear_language_go(spark):
    import corpus_pipeline

    rng = random.Random(4)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    by_lang = defaultdict(list)
    for r in docs.where("lang is not null and n_chars > 300").orderBy("doc_id").limit(200).collect():
        by_lang[r.lang].append(r.text)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=500)) for _ in range(20)] + [base64.b64encode(rng.randbytes(400)).decode() for _ in range(20)] + [rng.randbytes(200).hex() for _ in range(20)]
    junk += ["".join(rng.choices("абвгдежзиклмнопрстуфхцчшщыьэюя ", k=400)) for _ in range(20)]
    mixed = [" ".join(rng.choice(own)[:240] for own in by_lang.values()) for _ in range(20)]
    rows = [(1_000_000 + i, t) for i, t in enumerate(junk + mixed)]
    made = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, made, SF).select("doc_id").collect()}
    assert len(by_lang) == 4 and not kept & {d for d, _ in rows[: len(junk)]} and len(kept & {d for d, _ in rows[len(junk) :]}) <= 2
    lettered = {r.doc_id for r in docs.where(r"text rlike '\\p{L}'").collect()}
    assert len(lettered - kept) <= 0.002 * len(lettered)


def without_near_copies(texts):
    """By all pairs: of each class of Jaccard index 0.8 of five-word shingles the least id."""
    parts = {d: t.encode().lower().split() for d, t in texts.items()}
    sets = {d: {b" ".join(p[i : i + 5]) for i in range(max(1, len(p) - 4))} for d, p in parts.items()}
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in sets if find(d) == d}


def without_items(texts, items):
    kept = set()
    for d, t in texts.items():
        own = decontamination.words(t)
        shingles = {tuple(own[i : i + 3]) for i in range(len(own) - 2)}
        if not any(any(tuple(w[i : i + 3]) in shingles for i in range(len(w) - 2)) and slow_edits(w, own) <= 0.2 * len(w) for w in items):
            kept.add(d)
    return kept


def test_pipeline(spark, odd, none, tmp_path):
    """Each stage on what its predecessor kept, against brute force."""
    import corpus_pipeline
    from tokenizers import Tokenizer
    from quarry.llm.queries import tokenizer_path

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [decontamination.words(r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert kept.items() <= before.items() and len(kept) == docs.count()
        if name == "language ID":
            # learned from 200 documents here, so a few short ones may be unclear
            lettered = {d for d, t in before.items() if any(c.isalpha() for c in t)}
            assert set(kept) <= lettered and len(lettered) - len(kept) <= 0.02 * len(lettered)
        elif name == "exact dedup":
            assert set(kept) == {max(d for d, x in before.items() if x == t) for t in before.values()}
        elif name == "SimHash near-dedup":
            assert set(kept) == without_near_copies(before)
        else:
            assert set(kept) == without_items(before, items) < set(before)
        before = kept
    library, pieces = Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(before)
    for d, own in pieces.items():
        ids = np.array([*library.encode(before[d], add_special_tokens=False).ids, 1], "<u4")
        assert sum(n for _, n, _ in own) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in own)
    for rows in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF).columns == rows.columns
            assert stage(spark, rows, SF).count() <= rows.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()


def test_run_writes_each_stage_once(spark, monkeypatch):
    import corpus_pipeline

    read = []

    def seen(stage):
        return lambda spark, docs, sf_dir: (read.append(docs.inputFiles()), stage(spark, docs, sf_dir))[1]

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, seen(stage)) for name, stage in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, SF)
    places = [{f.rsplit("/", 1)[0] for f in files} for files in [*read, out.inputFiles()]]
    assert len(places) == 6 and all(len(p) == 1 for p in places) and len(set.union(*places)) == 6
    assert out.count() > 0
