"""Language ID, toxicity, decontamination and line dedup: brute force and held-out accuracy."""

import itertools
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from kestrel.llm import decontaminate as D
from kestrel.llm import language as L
from kestrel.llm import linededup as LD
from kestrel.llm import toxicity as X

SF = "/root/testdata/sf0.01"


# ---- language ------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    v = L.Vocabulary(L.vocabulary_bytes())
    p = np.random.default_rng(0).random((v.size, 3)) * 1e-3
    for word in ("the", "über", "a日", "x" * 9, "\u2603b"):
        s, total = "▁" + word, np.zeros(3)
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            parts, at = [], 0
            for k, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(s[at:k + 1])
                    at = k + 1
            probs = [p[v.pieces[x]] if x in v.pieces else
                     (np.prod([p[v.bytes[b]] for b in x.encode()], axis=0) if len(x) == 1 else None) for x in parts]
            if all(x is not None for x in probs):
                total += np.prod(probs, axis=0)
        assert np.allclose(v.forward([word], p)[0], np.log(total))


def test_forward_of_long_words_carries_the_sums_on():
    """Against a plain forward pass in logs over every character, across runs and in one batch with short words."""
    v = L.Vocabulary(L.vocabulary_bytes())
    rng = random.Random(5)
    p = np.random.default_rng(1).random((v.size, 2)) * 1e-3
    words = ["".join(rng.choice("theandingoné日") for _ in range(n)) for n in (1, 62, 63, 64, 65, 127, 128, 300, 5)]

    def plain(word):
        s = "▁" + word
        logs = [np.zeros(2)] + [np.full(2, -np.inf)] * len(s)
        for e in range(1, len(s) + 1):
            terms = [logs[i] + np.log(p[v.pieces[s[i:e]]]) for i in range(max(0, e - v.longest), e) if s[i:e] in v.pieces]
            if s[e - 1] not in v.pieces:
                terms.append(logs[e - 1] + sum(np.log(p[v.bytes[b]]) for b in s[e - 1].encode()))
            logs[e] = np.logaddexp.reduce(terms, axis=0)
        return logs[-1]

    assert np.allclose(v.forward(words, p), [plain(w) for w in words], rtol=1e-9)


def test_held_out_language_accuracy(spark):
    out = L.op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out, strict=True))


def test_language_odd_rows(make, odd, none):
    learning = make([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)])
    out = {r["doc_id"]: r for r in L.identify(odd, learning).collect()}
    assert [out[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0.0
    assert out[4]["lang_pred"] in ("en", "de") and L.identify(odd, learning).count() == odd.count()
    assert {r["lang_pred"] for r in L.identify(odd, learning.limit(0)).collect()} == {"und"}
    assert L.identify(none, learning).collect() == []
    tie = L.identify(make([(1, "qqq")]), make([(1, "same words", "b"), (2, "same words", "a")])).first()
    assert tie["lang_pred"] == "a" and tie["score"] == 0.5


# ---- toxicity -------------------------------------------------------------------------

def test_toxicity_against_plain_counts(make, spark):
    """The same Kneser-Ney models, written with dictionaries."""
    rng = random.Random(4)
    calm = ["the", "house", "and", "tree", "quiet", "river", "stone", "of", "Über", "x1"]
    rows = []
    for k in range(120):
        w = [rng.choice(calm) for _ in range(rng.randint(0, 12))]
        if k % 3 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "clown"]))
        if k % 9 == 0:
            w += "copied passage of ten".split()          # many documents, but one word before each
        rows.append((k, ", ".join(w) if k != 5 else None, int(k % 3 == 0)))
    docs, before, own = [{}, {}], [{}, {}], [{}, {}]
    for _, text, c in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for x in set(w):
            docs[c][x] = docs[c].get(x, 0) + 1
        for a, x in zip(["", *w], w, strict=False):
            before[c].setdefault(x, set()).add(a)
    size = [80, 40]

    def kept(x):
        k, g = [docs[c].get(x, 0) for c in (0, 1)], 0.0
        for c in (0, 1):
            for seen, share in ((k[c], sum(k) / 120), (size[c] - k[c], 1 - sum(k) / 120)):
                g += 2 * seen * math.log(seen / (size[c] * share)) if seen else 0
        rates = sorted(k[c] / size[c] for c in (0, 1))
        return g >= X.MIN_G and rates[1] >= X.MIN_RATIO * rates[0]
    words, d, nothing = {*docs[0], *docs[1]}, X.DISCOUNT, set()
    all_docs = {x: docs[0].get(x, 0) + docs[1].get(x, 0) for x in words}
    shared = {x: min(n, len(before[0].get(x, nothing) | before[1].get(x, nothing))) if kept(x) else n for x, n in all_docs.items()}
    for c in (0, 1):
        own[c] = {x: min(docs[c].get(x, 0), len(before[c].get(x, nothing))) for x in words if kept(x)}
    total = [sum(o.values()) for o in docs]
    free = [1 - sum(max(n - d, 0) for n in own[c].values()) / total[c] for c in (0, 1)]

    def p(c, x):
        low = (max(shared[x] - d, 0) + d * len(words) / (len(words) + 1)) / sum(shared.values())
        return max(own[c][x] - d, 0) / total[c] + free[c] * low
    want = {x: math.log(p(1, x) / p(0, x)) - math.log(free[1] / free[0]) for x in words if kept(x)}
    learning = make(rows, "doc_id long, text string, toxic int").repartition(3)
    counts = X.word_counts(learning)
    different = counts.where(X.differs(*size))
    weights = X.word_weights(counts, different.join(X.continuation_counts(learning, different), "word"), *size)
    got = {r["word"]: r["weight"] for r in weights.collect()}
    assert got.keys() == want.keys() and {"idiot", "clown", "passage"} <= got.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want) and got["idiot"] > 2 * got["passage"] > 0
    out = {r["doc_id"]: r["x"] for r in X.differences(make(rows, "doc_id long, text string, toxic int").select("doc_id", "text"), weights).collect()}
    for k, text, _ in rows:
        w = set(re.findall(r"[^\W_]+", (text or "").lower()))
        assert abs(out[k] - 100 * sum(want.get(x, 0) for x in w) / (len(w) + X.PRIOR_WORDS)) < 1e-9


def test_held_out_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = X.op9_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    found = held[held.predicted == 1]
    print("recall", held[held.toxic == 1].predicted.mean(), "precision", found.toxic.mean(), "false", (found.toxic == 0).sum())
    assert found.toxic.mean() > 0.97 and held[held.toxic == 1].predicted.mean() > 0.85
    assert held.score.between(0, 1).all()


def test_toxicity_odd_rows(make, odd, none):
    rows = [(k, "you idiot clown" if k % 2 else "the quiet house and the tree", k % 2) for k in range(60)]
    labelled = make(rows, "doc_id long, text string, toxic int")
    out = {r["doc_id"]: r["score"] for r in X.score(odd, labelled).collect()}
    assert out[1] == out[2] == out[3] and all(0 <= v <= 1 for v in out.values())
    assert {r["score"] for r in X.score(odd, labelled.where("toxic = 0")).collect()} == {0.5}
    assert X.score(none, labelled).collect() == []
    two = {r["doc_id"]: r["score"] for r in X.score(make([(1, "idiot!"), (2, "the house")]), labelled).collect()}
    assert two[1] > two[2]


# ---- decontamination ---------------------------------------------------------------------

def test_masks_hit_every_window_with_two_substitutions():
    for gone in itertools.combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        assert any(not {i + o for o in m} & set(gone) for m in D.MASKS for i in range(D.WINDOW - m[-1]))


def test_planted_passages(make, spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 13, 12, 6, 4, 40])] + [(5, ""), (6, None)]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, tokens string")
    noise = lambda: " ".join(word() for _ in range(50))

    def changed(text, places):
        w = text.split()
        for p in places:
            w[p] = "changed"
        return " ".join(w)
    docs = make([
        (0, noise() + " " + items[0][1].upper().replace(" ", ", ") + " " + noise()),
        (1, noise() + " " + changed(items[1][1], [3, 7])), (2, noise() + " " + changed(items[1][1], [3, 7, 10])),
        (3, items[2][1] + " " + noise()), (4, changed(items[2][1], [5])), (5, items[3][1]), (6, items[4][1]),
        (7, noise() + " " + " ".join(items[5][1].split()[10:23]) + " " + noise()),
        (8, " ".join(items[5][1].split()[10:20])), (9, noise()), (10, None), (None, items[0][1]), (12, "a " * 5000)])
    found = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}
    assert found == {(0, 0), (1, 1), (3, 2), (5, 3), (6, 4), (7, 5), (None, 0)}
    left = D.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 4, 8, 9, 10, 12}
    assert D.leaks(docs, bench.limit(0)).collect() == [] and D.leaks(docs.limit(0), bench).collect() == []


def plain_tokens(text):
    import regex
    spaced = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 ", (text or "").lower())
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", spaced) if t]


def leaked(text, item):
    """Brute force over all alignments."""
    doc, want = plain_tokens(text), plain_tokens(item)
    if len(want) < D.MIN_TOKENS:
        return bool(want) and any(plain_tokens(u) == want for u in [*(text or "").split("\n"), text])
    width = min(D.WINDOW, len(want))
    need = len(want) if len(want) < D.WINDOW else D.WINDOW - D.SUBSTITUTIONS
    return any(sum(0 <= at + j < len(doc) and doc[at + j] == want[j] for j in range(s, s + width)) >= need
               for at in range(-len(want), len(doc)) for s in range(len(want) - width + 1))


def test_leaks_match_brute_force(make, spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr"]) + rng.choice("xyz")
    items = [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 8, 12, 13, 14, 20, 30)] + ["日本語の文です。次の文", "愛", None, "!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = []
    for k in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(2)]
        own = (rng.choice(items) or "").split(" ")
        if len(own) > 12:
            cut = rng.randint(0, len(own) - 12)
            own = own[cut:cut + rng.randint(11, 20)]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        sep = rng.choice([" ", "\n"])
        rows.append((rng.choice([k, None, 7]), f"{parts[0]}{sep}{' '.join(own)}{sep}{parts[1]}"))
    rows += [(900, "x 日本語の文です。次の文 y"), (901, "日本語の文"), (902, "愛"), (903, "愛 する")]
    docs = make(rows)
    want = sorted((str(i), t, k) for i, t in rows for k, item in enumerate(items) if leaked(t, item))
    found = D.leaks(docs, bench).select(*[F.col(c).alias(f"l_{c}") for c in D.KEY], "item_id").distinct()
    own = docs.select(*D.keyed(docs), "text")
    got = own.join(found, D.same_row(own, found, "l_")).select("doc_id", "text", "item_id").distinct().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(set(want)) and len(want) > 40
    left = sorted((str(r["doc_id"]), r["text"]) for r in D.decontaminated(docs, bench).collect())
    assert left == sorted((str(i), t) for i, t in rows if not any(leaked(t, item) for item in items))


def test_clean_rows_without_an_id_stay(make, spark):
    bench = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    docs = make([(None, " ".join(f"w{k}" for k in range(20))), (None, "clean one"), (None, "clean two"), (None, None)])
    assert sorted(str(r["text"]) for r in D.decontaminated(docs, bench).collect()) == ["None", "clean one", "clean two"]


# ---- lines ------------------------------------------------------------------------------

def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def mutated(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randint(0, len(s))
        what = rng.random()
        if what < .33 or not s:
            s.insert(k, rng.choice("abcdé"))
        elif what < .66:
            s.pop(min(k, len(s) - 1))
        else:
            s[min(k, len(s) - 1)] = rng.choice("abcdé")
    return "".join(s)


def test_banded_distance_and_keys():
    rng = random.Random(4)
    for _ in range(5000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        b = mutated(rng, a, rng.randint(0, 4))
        close = edits(a, b) <= LD.MAX_EDITS
        assert LD.within(a, b) == close
        if close and min(len(a), len(b)) >= LD.MIN_CHARS:
            (ka, oa), (kb, ob) = LD.line_keys(a), LD.line_keys(b)
            own_a, own_b = ({k for k, o in zip(*x, strict=True) if o} for x in ((ka, oa), (kb, ob)))
            assert len(own_a) == len(own_b) == LD.MAX_EDITS + 1 and (own_a & set(kb) or own_b & set(ka))


def test_line_classes_match_brute_force(make):
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(15, 60))).strip() for _ in range(25)]
    rows = [(k, "\n".join(mutated(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 5])) for _ in range(6))) for k in range(60)]
    lines = [(i, k, s) for i, t in rows for k, s in LD.lines_of(t)]
    distinct = list(dict.fromkeys(s for *_, s in lines))
    top = {s: s for s in distinct}

    def find(s):
        while top[s] != s:
            s = top[s]
        return s
    for a, b in itertools.combinations([s for s in distinct if len(s) >= LD.MIN_CHARS], 2):
        if edits(a, b) <= LD.MAX_EDITS:
            top[find(a)] = find(b)
    first = {}
    for i, k, s in lines:
        first.setdefault(find(s), (i, k))
    want = sorted((i, k, *first[find(s)], first[find(s)] == (i, k)) for i, k, s in lines)
    assert sorted(tuple(r)[1:] for r in LD.line_classes(make(rows)).collect()) == want


def test_line_odd_rows(odd, none):
    out = LD.line_classes(odd)
    assert sorted((r["doc_id"], r["place"]) for r in out.where("NOT kept").collect()) == [(7, 0), (8, 0)]
    assert LD.line_classes(none).collect() == []


def test_lines_of_rows_without_an_id(make):
    """Every input row is a document of its own, whatever its id."""
    line = "a line that is long enough to be compared"
    docs = make([(None, f"{line}\nanother one"), (None, f"{line}\na third line"), (None, None), (5, line), (5, line + "!")])
    out = LD.line_classes(docs).collect()
    assert len({r["row"] for r in out}) == 4 and sum(r["kept"] for r in out) == 3
    kept = [r for r in out if r["kept"] and r["doc_id"] == 5]
    assert len(kept) == 1 and all(r["class_doc"] == 5 for r in out if r["doc_id"] is not None)
