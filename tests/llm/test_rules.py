"""Line rules, URL filters and mixing on small cases."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimwise.llm import line_rules, mixing, urls

from .conftest import CLASH, random_docs


def brute_rules(rows, min_docs, share):
    """rows: (key, text, host)."""
    def words(t):
        return [w.decode() for w in (t or "").encode().split()]

    def norm(line):
        return " ".join(w.decode() for w in line.encode().lower().split())

    holds, texts = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        texts[host].add(t or "")
        for line in (t or "").split("\n"):
            if words(line):
                holds[host, norm(line)].add(t)
    out = {}
    for k, t, host in rows:
        ws, lines, seen = words(t), [x for x in (t or "").split("\n") if words(x)], Counter()
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        hit = {i + j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(3)}
        dup = sum(1 for x in lines if (seen.update([x]) or seen[x]) > 1)
        lost = sum(len(words(x)) for x in lines if len(holds[host, norm(x)]) > max(min_docs, share * len(texts[host])))
        failed = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
        out[k] = (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit), lost, failed, not failed and lost <= 0.5 * len(ws))
    return out


def test_line_rules(spark):
    rows = []
    for k, t in random_docs(80, 5):
        lines = [(t or "").replace(" ", "\n", 3) if t is not None else None]
        if k % 3 == 0 and t:
            lines.append("All  Rights\tReserved by all of us")
        if k % 4 == 0 and t:
            lines.append("all rights reserved BY all of us #$|\r")
        rows.append((k, None if lines[0] is None else "\n".join(lines), ["a", "b", None][k % 3 if k % 5 else 0]))
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], "doc_id long, text string, source string" + "".join(f", {c} string" for c in CLASH))
    got = line_rules.quality_rules(docs, min_docs=4, share=0.05).collect()
    want = brute_rules(rows, 4, 0.05)
    assert {g.doc_id: (*(g[c] for c in line_rules.COUNTS), g.n_frequent_words, g.base_failed, g.kept) for g in got} == want
    assert any(w[5] for w in want.values())


def test_copies_count_as_one_document_and_lines_are_removed(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(k, body + "\nsame line", "a") for k in range(30)]
    rows += [(100 + k, " ".join(f"v{k}_{i}" for i in range(60)) + "\nFooter  text\nend", "a") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = line_rules.quality_rules(docs, min_docs=5, share=0)
    got = {g.doc_id: g for g in judged.collect()}
    assert got[3].n_frequent_words == 0 and got[3].kept
    assert got[101].n_frequent_words == 3
    left = {r.doc_id: r.text for r in line_rules.remove_lines(docs, judged).collect()}
    assert len(left) == 38 and left[101].endswith("59") and left[3] == rows[3][1]


def test_limit_of_a_large_host_and_copies(spark):
    body = lambda k: " ".join(f"v{k}_{i}" for i in range(60))
    rows = [(k, body(k) + ("\nFooter text" if k < 20 else ""), "a") for k in range(100)]
    rows += [(100 + k, body("copy") + "\nonly copies", "a") for k in range(12)] * 2
    docs = spark.createDataFrame(rows, "id long, text string, source string")

    def lost(**how):
        judged = line_rules.quality_rules(docs, key="id", min_docs=5, share=0.25, **how).collect()
        return {r.id: r.n_frequent_words for r in judged if r.n_frequent_words}

    footer = dict.fromkeys(range(20), 2)
    assert lost() == {}  # 20 of 101 texts
    assert lost(max_docs=19) == footer and lost(max_docs=20) == {}
    assert lost(max_docs=11, copies=True) == footer | dict.fromkeys(range(100, 112), 62)
    assert lost(max_docs=12, copies=True) == footer  # repeated rows are one document


def test_line_rules_very_long_texts(spark):
    """A line of 60,000 words and a text of 60,000 lines are judged whole."""
    wide, tall = " ".join(f"w{i}" for i in range(60_000)), "\n".join(f"a{i} b{i} c{i}" for i in range(60_000))
    rows = [(k, f"{wide}\nmine {k}" if k < 7 else f"{tall}\nmine {k}" if k < 9 else f"own text {k}", "h") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.quality_rules(docs, min_docs=5, share=0, copies=True).collect()
    want = brute_rules(rows, 5, 0)
    assert {g.doc_id: (*(g[c] for c in line_rules.COUNTS), g.n_frequent_words, g.base_failed, g.kept) for g in got} == want
    assert {g.doc_id for g in got if g.n_frequent_words} == set(range(7)) and all(g.kept == (g.doc_id in (7, 8)) for g in got)


def test_line_rules_empty(spark, make_docs):
    assert line_rules.quality_rules(make_docs([])).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
CASES = {
    "http://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://WWW.Example.com/en/x?q=/es/": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://notexample.com/en/1#t": ("notexample.com", "/en/1", "com/", "allow"),
    "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
    "http://cheap-pills-casino.org/buy-now": ("cheap-pills-casino.org", "/buy-now", None, "block"),
    "https://library.museum.org/history/": ("library.museum.org", "/history/", None, "allow"),
    "http://a.com": ("a.com", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "x://?q": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


@pytest.mark.parametrize("inline", [500, 0])
def test_urls(spark, monkeypatch, inline):
    monkeypatch.setattr(urls, "INLINE_RULES", inline)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(CASES)] * 2, "page_id long, url string, host string, path string")
    got = urls.judge_urls(pages, RULES).collect()
    assert len(got) == 2 * len(CASES)
    for g in got:
        assert (g.host, g.path, g.rule, g.verdict) == list(CASES.values())[g.page_id]
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0


def test_url_model_on_held_out_words():
    """Words of neither list alone: half of each list is held out."""
    rows = urls.labelled_urls()
    model = urls.fit([r for i, r in enumerate(rows) if i // 3 % 4])
    held = [r for i, r in enumerate(rows) if not i // 3 % 4]

    def p(u):
        b = urls.buckets("".join(urls.split_url(u)))
        return model.bias + sum(model.weights[x] for x in b) / len(b)

    right = sum((p(u) > 0) == bool(y) for u, y in held)
    assert right / len(held) > 0.7


def test_spark_logit_equals_python(spark):
    texts = ["cheap-pills.example.com/en/1", "ab", "", "é日本/x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(urls.logit(F.col("t"), urls.default_model())).collect()]
    m = urls.default_model()
    for t, g in zip(texts, got):
        b = urls.buckets(t)
        assert abs(g - (m.bias + (sum(m.weights[x] for x in b) / len(b) if b else 0))) < 1e-9


def leaf_budgets(spark, leaves, weights, given, epochs=1):
    df = spark.createDataFrame(leaves, "a string, b string, tokens long")
    out = mixing.leaf_budgets(df, ["a", "b"], weights, spark.createDataFrame([(given,)], "given long"), epochs)
    return {(r.a, r.b): r.budget for r in out.collect()}


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("x", "p", 100), ("x", "q", 1000), ("y", "p", 1000), ("y", "q", 1000)]
    got = leaf_budgets(spark, leaves, {}, 1000)
    assert got == {("x", "p"): 100, ("x", "q"): 400, ("y", "p"): 250, ("y", "q"): 250}
    got = leaf_budgets(spark, leaves, {"a": {"x": 3, "y": 1}}, 2000)  # x is full at 1100, the rest goes up
    assert got == {("x", "p"): 100, ("x", "q"): 1000, ("y", "p"): 450, ("y", "q"): 450}
    assert leaf_budgets(spark, leaves, {"a": {"x": 0}}, 500) == {("x", "p"): 0, ("x", "q"): 0, ("y", "p"): 250, ("y", "q"): 250}
    assert sum(leaf_budgets(spark, leaves, {}, 10**6, 3).values()) == 3 * 3100
    assert leaf_budgets(spark, [(None, "p", 50), ("y", None, 50)], {}, 20) == {(None, "p"): 10, ("y", None): 10}


@pytest.mark.parametrize("share,digits", [(0.3, 3), (0.9, 1), (2.5, 2)])
def test_prefix_of_each_epoch(spark, monkeypatch, share, digits):
    import hashlib

    monkeypatch.setattr(mixing, "SLOT_DIGITS", digits)
    rows = [(k, t, f"s{k % 3}" if k % 7 else None) for k, t in random_docs(150, 8)] + [(400, "w " * 30, "s1")] * 3
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, tokens long, cut string")
    small, plan = mixing.plan_mix(docs.select("doc_id", "text", "source"), ["source"], {"source": {"s0": 2}}, share=share, max_epochs=2, seed=9)
    got = Counter((r.doc_id, r.epoch) for r in mixing.select_mix(small, plan, ["source"], seed=9).collect())
    want = Counter()
    for p in plan.collect():
        mine = [(k, len((t or "").split())) for k, t, s in rows if s == p.source]
        assert p.tokens == sum(n for _, n in mine) and p.budget <= 2 * p.tokens
        for e in range(p.epochs):
            want.update((k, e) for k, _ in mine)
        left = p.budget - p.epochs * p.tokens
        if left > 0:
            key = lambda k: hashlib.md5(f"9-{p.epochs}-{k}".encode()).hexdigest()  # noqa: E731, B023
            taken = 0
            for h in sorted({key(k) for k, _ in mine}):
                taken += sum(n for k, n in mine if key(k) == h)
                if taken > left:
                    break
                want.update((k, p.epochs) for k, _ in mine if key(k) == h)
    assert got == want


def test_mix_empty(spark, make_docs):
    small, plan = mixing.plan_mix(make_docs([]), ["source"], {}, share=0.5)
    assert mixing.select_mix(small, plan, ["source"]).count() == 0


@pytest.mark.parametrize("name", ["cap", "weight", "tokens", "left", "k", "n", "slot", "budget", "level", "given", "epochs", "before", "level0", "cut", "_epochs"])
def test_mix_levels_of_any_name(spark, make_docs, name):
    rows = [(k, "w " * (k % 7 + 1)) for k in range(60)]
    docs = make_docs(rows, ("epoch_", "cut_")).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    take = lambda d, level: Counter((r.doc_id, r.epoch) for r in mixing.select_mix(d, mixing.plan_mix(d, [level], {level: {"s0": 2}}, share=0.6, max_epochs=2, seed=9)[1], [level], seed=9).collect())
    assert take(docs.withColumnRenamed("source", name), name) == take(docs, "source")


def test_mix_keeps_columns_and_refuses_a_second_epoch(spark, make_docs):
    docs = make_docs([(k, "a b") for k in range(9)], ("_epochs", "_cut", "_level0"))
    _, plan = mixing.plan_mix(docs, ["source"], {}, share=0.5)
    got = mixing.select_mix(docs, plan, ["source"])
    assert got.columns == [*docs.columns, "epoch"] and {r._epochs for r in got.collect()} == {"x"}
    with pytest.raises(ValueError):
        mixing.select_mix(docs.withColumn("epoch", F.lit("mine")), plan, ["source"])
