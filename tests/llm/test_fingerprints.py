import hashlib
import random

import numpy as np

from clerkwise.llm import banding
from clerkwise.llm import edit_embedding as ee

from .brute import texts


def walk(text):
    """The embedding, one step at a time."""
    classes, at, out = ee.classes_of(text), 0, []
    for step in range(max(ee.STEPS * len(classes), 1)):
        here = int(classes[at]) if at < len(classes) else ee.PAD
        out.append(here)
        at += int(ee._moves(step, 1)[0][here])
    return np.array(out)


def test_walks_advance_together_as_alone():
    rows = [t for t in texts() if t is not None]
    samples = ee.Samples()
    got = ee.fingerprints([ee.classes_of(t) for t in rows], samples)
    for t, f in zip(rows[::5], got[::5], strict=True):
        met = walk(t)
        assert (ee.SYMBOL[met[samples.of(np.array([len(met)]))[0]]] == f).all()


def test_few_edits_change_few_places():
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(800)) for _ in range(40)]
    samples = ee.Samples()
    own = ee.fingerprints([ee.classes_of(t) for t in base], samples)
    means = []
    for edits in (1, 4, 16, 64):
        changed = []
        for t in base:
            for _ in range(edits):
                p = rnd.randrange(len(t))
                t = t[:p] + rnd.choice(["", "x", t[p] + "y"]) + t[p + 1:]
            changed.append(ee.classes_of(t))
        means.append(ee.likeness(own, ee.fingerprints(changed, samples)).mean())
    assert means == sorted(means, reverse=True) and means[0] > 0.9
    assert ee.likeness(own, np.roll(own, 1, axis=0)).mean() < 0.3


def test_next_document_and_edited_text(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts())] + [(None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, bucket int, ends boolean").repartition(4)
    out = ee.fingerprint_documents(docs).collect()
    assert len(out) == len(rows)
    plain = {r["doc_id"]: r for r in out}
    order = sorted({i for i, _ in rows if i is not None and i != 7}, reverse=True)
    text_of = {i: t or "" for i, t in rows}
    same = {}
    for a, b in zip(order, order[1:], strict=False):
        if a > 7 > b or 7 in (a, b):
            continue
        t, u = text_of[a], text_of[b]
        edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        r = plain[a]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"] and same.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    # The last in the order, the null id, is followed by the first.
    t, u = "null id", text_of[order[0]]
    assert plain[None]["edited_sha256"] == hashlib.sha256((t[:4] + u[:3]).encode()).hexdigest()
    assert ee.fingerprint_documents(docs.limit(0)).count() == 0
    one = ee.fingerprint_documents(docs.where("doc_id is null")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"nullnul").hexdigest()


def near_rows(n=220, seed=9):
    """Texts with families of few edits, far apart in the order of ids."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(600)) for _ in range(n // 4)]
    out = list(base)
    for k in range(n - len(base)):
        t = base[k % 7] if k % 2 else out[rnd.randrange(len(out))]
        for _ in range(k % 3):
            p = rnd.randrange(len(t))
            t = t[:p] + rnd.choice(["", "x", t[p] + "y"]) + t[p + 1:]
        out.append(t)
    return out


def test_bands_find_nearly_every_pair_within_the_distance(spark):
    rows = near_rows()
    samples = ee.Samples()
    prints = ee.fingerprints([ee.classes_of(t) for t in rows], samples)
    bits = np.unpackbits((prints[:, ::2] << 4 | prints[:, 1::2]).astype(np.uint8), axis=1)
    far = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    near = far <= banding.DISTANCE
    label = np.arange(len(rows))
    while True:
        least = np.where(near, label[None, :], len(rows)).min(axis=1)
        if (least == label).all():
            break
        label = least
    assert len(set(label)) < len(set(rows)) and (near & (far > 0)).sum() > 100
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    # Also with entries cut into many blocks.
    for block in (banding.BLOCK, 4):
        out = {r["doc_id"]: r for r in banding.fingerprint_groups(docs, block).collect()}
        assert len(out) == len(rows) and [out[i]["fingerprint"] for i in range(len(rows))] == ee.as_text(prints)
        names = np.array([out[i]["representative"] for i in range(len(rows))])
        together = names[:, None] == names[None, :]
        # Nothing is together that no chain of near pairs connects; of the near pairs of different fingerprints nearly all are.
        assert not (together & (label[:, None] != label[None, :])).any()
        assert together[near & (far > 0)].mean() >= 0.97 and together[far == 0].all()
        assert all(n in {out[j]["fingerprint"] for j in np.flatnonzero(label == label[i])} for i, n in enumerate(names))
    assert banding.fingerprint_groups(docs.limit(0)).count() == 0


def test_recall_of_the_bands():
    """Pairs at each distance that share a band, and pairs that have nothing to do with each other."""
    rnd = np.random.default_rng(7)
    prints = rnd.integers(0, 256, (4000, banding.BITS // 8), dtype=np.uint8)
    own = banding.band_keys(prints)
    found = {}
    for distance in (8, 16, 20, banding.DISTANCE):
        other = np.unpackbits(prints, axis=1)
        for row in other:
            row[rnd.choice(banding.BITS, distance, replace=False)] ^= 1
        found[distance] = (banding.band_keys(np.packbits(other, axis=1)) == own).any(axis=1).mean()
    assert found[8] == 1 and found[16] > 0.998 and found[20] > 0.985 and found[banding.DISTANCE] > 0.965
    # Eight million unrelated pairs.
    assert len(np.unique(own)) == own.size


def test_recall_by_edits(spark):
    """What share of texts with some random edits is linked with the original: measured, as the README states it."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    rows, edits = [], []
    for k in range(240):
        base = " ".join(rnd.choice(words) for _ in range(300))
        text = base
        for _ in range((1, 2, 4, 8)[k % 4]):
            p = rnd.randrange(len(text))
            text = text[:p] + rnd.choice(["", "x", text[p] + "y"]) + text[p + 1:]
        rows += [base, text]
        edits.append((1, 2, 4, 8)[k % 4])
    out = {r["doc_id"]: r["representative"] for r in banding.fingerprint_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    share = {n: np.mean([out[2 * k] == out[2 * k + 1] for k in range(240) if edits[k] == n]) for n in (1, 2, 4, 8)}
    print("linked by number of edits", share)
    assert share[1] >= 0.9 and share[1] >= share[2] >= share[8]
    assert len(set(out.values())) >= 240


def test_long_texts_are_walked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ee, "PART_CHARS", 100)
    rows = ["ab c" * 30, "x", "", "the quick brown fox " * 40, "lazy dog " * 23]
    samples = ee.Samples()
    got = ee.fingerprints([ee.classes_of(t) for t in rows], samples)

    def walk_in_parts(text):
        classes, out = ee.classes_of(text), []
        for step in range(max(ee.STEPS * len(classes), 1)):
            if step % (ee.STEPS * 100) == 0:
                at = step // ee.STEPS
            here = int(classes[at]) if at < len(classes) else ee.PAD
            out.append(here)
            at += int(ee._moves(step, 1)[0][here])
        return np.array(out)

    for t, f in zip(rows, got, strict=True):
        met = walk_in_parts(t)
        assert (ee.SYMBOL[met[samples.of(np.array([len(met)]))[0]]] == f).all()
    monkeypatch.undo()
    # An edit near the start of a text of many parts; other columns with the names that the operator gives.
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(400_000))
    docs = spark.createDataFrame([(2, long, "q", 5), (1, long[:50] + "zz" + long[50:], "q", 5)], "doc_id long, text string, fingerprint string, n_chars int")
    out = {r["doc_id"]: r for r in banding.fingerprint_groups(docs).collect()}
    assert out[2]["n_chars"] == 400_000 and out[2]["near_next"] > 0.9 and out[1]["representative"] == out[2]["representative"]


def test_links_are_verified(spark):
    prints = np.random.default_rng(3).integers(0, 256, (300, 64), dtype=np.uint8)
    for k in range(100):
        prints[100 + k] = prints[k]
        prints[100 + k].view(np.uint64)[k % 8] ^= np.uint64((1 << (15 + k % 16)) - 1)
    frame = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "node long, print binary")
    links, members = banding.fingerprint_links(frame)
    got = {(r["a"], r["b"]): r["distance"] for r in links.collect()}
    within = {(100 + k, k): 15 + k % 16 for k in range(100) if 15 + k % 16 <= banding.DISTANCE}
    assert got.items() <= within.items() and len(got) >= 0.95 * len(within)
    assert {r["node"]: r["root"] for r in members.collect()} == {x: b for a, b in got for x in (a, b)}
