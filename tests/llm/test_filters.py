"""URL rules, quality rules, licences and mixing: brute force and defined cases."""

import re

import pytest

from kestrel.llm import licenses, mixing, quality, urls

SF = "/root/testdata/sf0.001"


# ---- URLs ------------------------------------------------------------------------

def test_rule_tokens_and_patterns():
    assert urls.literal_tokens("||example.com/en/") == ["com", "en", "example"]
    assert urls.literal_tokens("||example.com/en") == ["com", "example"]
    assert urls.literal_tokens("/ads*banner/") == []
    assert re.search(urls.rule_pattern("||a.com/"), "x.a.com/") and not re.search(urls.rule_pattern("||a.com/"), "xa.com/")
    assert re.search(urls.rule_pattern("/x^"), "h/x") and not re.search(urls.rule_pattern("/x^"), "h/xy")
    assert re.search(urls.rule_pattern("/x|"), "h/x") and not re.search(urls.rule_pattern("/x|"), "h/x/y")


def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    return {r["page_id"]: tuple(r)[1:5] for r in urls.judge(df, **kw).collect()}


def test_contract_rules_and_odd_urls(spark):
    out = judged(spark, [
        (1, "http://WWW.Example.com/en/x?q#f", "clash"), (2, "https://a.example.com/en/", None), (3, "http://b.com", None),
        (4, "http://b.com/x", None), (5, None, None), (6, "no scheme", None), (7, "ftp://a.net/es/1", None),
        (8, "http://notexample.com/en/", None), (9, "http://cheap-pills.example.org/q", None), (None, "://net/fr/", None),
        (11, "http://net/ES/", None), (12, "x://y://z.com/", None)])
    assert out[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert out[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert out[3] == ("b.com", "", None, "allow") and out[4][2:] == ("com/", "allow")
    assert out[5] == out[6] == ("", "", None, "allow") and out[7][2:] == ("net/es/", "block")
    assert out[8][2:] == ("com/", "allow") and out[9][2:] == (None, "block")
    assert out[None][2:] == ("net/fr/", "block") and out[11][2] is None and out[12] == ("y:", "//z.com/", None, "allow")


def test_only_candidates_run(spark):
    rows = [(k, f"http://h{k}.org/p", None) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = urls.judge(df, host_rules=(("block", "h3.org/"), ("block", "h4.org/p")), pattern_rules=()).collect()
    assert {r["page_id"]: r["n_candidates"] for r in out if r["n_candidates"]} == {3: 1, 4: 1}
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == {3, 4}
    assert urls.judge(df.limit(0)).collect() == []


# ---- quality ----------------------------------------------------------------------

def brute_repeats(words):
    w = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, x in enumerate(w):
        if w.count(x) > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


@pytest.mark.parametrize("text", ["", "a", "a a a a", "a b c a b c", "x y z q x y z", "one two\nthree one two three\n\n \none two",
                                  "a b a b a b a", "# * $x% &|<> y\nq\nq\n q\nq"])
def test_base_counts(text):
    words = text.split()
    n, chars, symbols, dup, repeat, _ = quality.statistics(text)
    lines = text.split("\n")
    assert (n, chars) == (len(words), sum(map(len, words)))
    assert symbols == sum(text.count(c) for c in "#*$%&|<>")
    assert dup == sum(bool(x.strip()) and x in lines[:k] for k, x in enumerate(lines))
    assert repeat == brute_repeats(words)


def test_white_space_is_the_six_characters():
    assert quality.statistics("a\x1cb\x85c\u00a0d e")[0] == 2


def test_forest_separates_junk_and_keeps_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs, labels).join(labels, "doc_id").where("NOT base_failed").toPandas()
    clean = out[(out.quality == 1) & (out.n_symbols == 0)]
    assert clean.kept.mean() > 0.9
    assert (~out[out.quality == 0].kept).mean() > 0.7
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {
        r[0] for r in quality.judge(docs, labels).where("kept").select("doc_id").collect()}


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(odd, labels)
    assert out.count() == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in out.collect())  # short, or "long long long ..."
    assert quality.judge(none, labels).collect() == [] and quality.drop_rejected(none, labels).collect() == []
    empty = labels.limit(0)
    assert quality.judge(odd, empty).count() == odd.count()


# ---- licences ------------------------------------------------------------------------

def test_pruned_scan_equals_full_scan(spark):
    m = licenses.Matcher()
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [t for _, t in licenses.TEMPLATES] + ["Licensed under the Apache License, Version 2.0", "Released under MIT License"]
    for text in texts:
        for line in text.split("\n"):
            w = licenses.normal_words(line)
            own = licenses.bigrams(w)
            full = [(-2 * len(own & t) / (len(own) + len(t)), n) for t, n in m.templates if own]
            full = [f for f in full if -f[0] >= m.min_dice]
            assert m.best(w) == ((-min(full)[0], min(full)[1]) if full else None)


def test_licences_embedded_in_other_text():
    m, by = licenses.Matcher(), {}
    for name, text in licenses.TEMPLATES:
        by[name] = text
        words, k = text.split(), len(text.split()) // 2
        noise = " ".join(f"noise{j}" for j in range(33))
        for t in (f"{noise} {text} {noise}", f"# {noise}\n# {' '.join(words[:k])}\n#\n# {' '.join(words[k:])}\n# {noise}"):
            assert {x[0] for x in m.scan(t)} == {name}, (name, m.scan(t))
            assert max(r[0] for r in m.runs(licenses.normal_words(t))) == 1.0
    assert m.scan("The code samples in this chapter are released under the MIT License.") == [("MIT", 1.0, 0, 1)]
    two = f"intro {by['GPL-3.0']} and {by['BSD-2-Clause'].replace('retain', 'keep')} end"
    assert {x[0] for x in m.scan(two)} == {"GPL-3.0", "BSD-2-Clause"}
    assert m.scan("the license of the software is not named in this text " * 50) == []


def test_licence_units_and_odd_rows(make, odd, none):
    mit = dict(licenses.TEMPLATES)["MIT"]
    half = len(mit.split()) // 2
    wrapped = " ".join(f"intro{k}" for k in range(200)) + "\n\n" + " ".join(mit.split()[:half]) + "\n" + " ".join(mit.split()[half:]) + "\n\nbye"
    out = {r["doc_id"]: r["matches"] for r in licenses.scan(make([(1, wrapped), (2, "some words before it\nReleased under the MIT License.\nsome words after it")])).collect()}
    assert [(m["license"], m["first_line"], m["n_lines"]) for m in out[1]] == [("MIT", 2, 2)]
    assert [(m["license"], m["first_line"], m["n_lines"], m["score"]) for m in out[2]] == [("MIT", 1, 1, 1.0)]
    assert all(r["matches"] == [] for r in licenses.scan(odd).collect()) and licenses.scan(odd).count() == odd.count()
    assert licenses.scan(none).collect() == []


# ---- mixing ----------------------------------------------------------------------------

def fill(sizes, weights, budget, cap):
    """Shares by plain rounds of resharing."""
    target, total = dict.fromkeys(sizes, 0.0), budget * sum(sizes.values())
    left, open_ = total, {s for s in sizes if sizes[s]}
    while left > 1e-9 and open_:
        share = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weights[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_copies(make):
    rows = [(k, "w " * (k % 7 + 1), "en", s) for k, s in enumerate(["b", "a", None, "a", "é", "Z", "b", "a"] * 40)]
    rows += [(1000, None, "en", "void"), (1001, "", "en", "a")]
    out = mixing.mix(make(rows)).toPandas()
    sizes = out.fillna({"source": "~null"}).groupby("source")["size"].sum().to_dict()
    order = sorted([s for s in sizes if s != "~null"]) + ["~null"]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = fill(sizes, weights, 1.5, 2.0)
    for s, g in out.fillna({"source": "~null"}).groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert (g.taken <= 2 * g["size"]).all()
        assert g.taken.sum() == pytest.approx(want[s], rel=0.35, abs=1)
    again = mixing.mix(make(rows[::-1]).repartition(5)).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    emitted = mixing.emit_mixed(make(rows))
    assert emitted.columns == make(rows).columns and emitted.count() == out.copies.sum()


def test_rows_without_an_id_are_drawn_one_by_one(make):
    docs = make([(None, f"some words of text number {k}", None, "a") for k in range(1000)] + [(1, "x " * 4000, None, "b")])
    out = mixing.mix(docs, budget=0.5).where("source = 'a'")
    target, taken = out.select("target").first()[0], out.agg({"taken": "sum"}).first()[0]
    assert 0 < target < 5900 and abs(taken - target) < 0.15 * target


def test_mixing_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.count() == odd.count()
    assert {r["taken"] for r in out.where("doc_id <= 3").collect()} == {0}
    assert mixing.mix(none).collect() == [] and mixing.emit_mixed(none).collect() == []
