import math
import re

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import url_filter as u

URLS = ["http://a.com", "http://a.com/", "https://WWW.Example.com/en/x?q=1&r=2#f", "http://example.com/en", "http://sub.example.com/en/", "ftp://x.net/fr/1", "http://x.net/es", "http://xcom/y", "com/", None, "", "://", "a://b://c/d", "http://h?x/y", "http://é.com:80/ü#/", "http://notexample.com/en/", "http://www.example.com/en/", "http://m.www.example.com/en/1"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_hosts_paths_rules(spark):
    rows = spark.createDataFrame([(k, x, 1) for k, x in enumerate(URLS)] + [(3, URLS[3], 2)], "page_id long, url string, host int")
    got = u.judge(rows, u.Model(None, -1.0, ())).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert u.judge(rows.limit(0), u.Model(None, -1.0, ())).collect() == []


def test_features(spark):
    url, host, path = F.col("url"), u.host_of(F.col("url")), u.path_of(F.col("url"))
    rows = spark.createDataFrame([(x,) for x in URLS], "url string").select("url", *[c.alias(k) for k, c in u.lexical(url, host, path, u.letters_of(url)).items()]).collect()
    for r in rows:
        text, (h, p, _, _) = r["url"] or "", brute(r["url"])
        n = max(len(text), 1)
        entropy = -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text))
        query = re.search(r"\?([^#]*)", text)
        assert (r["url_length"], r["host_length"], r["depth"], r["n_hyphens"]) == (len(text), len(h), p.count("/"), h.count("-"))
        assert abs(r["entropy"] - 1000 * entropy) <= 1.001 and r["digit_ratio"] == 1000 * sum(c in "0123456789" for c in text) // n
        assert r["n_params"] == (query[1].count("&") + 1 if query else 0)


def test_trees_learn_and_the_expression_is_the_model(spark):
    rng = np.random.default_rng(0)
    rows = [(f"http://site{rng.integers(99)}.org/{'x/' * int(d)}{rng.integers(10**6)}", bool(d > 3)) for d in rng.integers(0, 8, 1500)]
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    model = u.train(frame)
    got = u.judge(frame.withColumn("page_id", F.lit(1)), model, rules=(), keep=("blocked",)).collect()
    assert np.mean([(r["verdict"] == "block") == r["blocked"] for r in got]) > 0.99


def test_few_labels(spark):
    schema = "url string, blocked boolean"
    assert u.train(spark.createDataFrame([], schema)).prior == -1.0
    assert u.train(spark.createDataFrame([("http://a", True), (None, None)], schema)).prior == 1.0
    model = u.train(spark.createDataFrame([("http://a", True), (None, False)], schema))
    assert u.judge(spark.createDataFrame([(1, None)], "page_id long, url string"), model).first()["verdict"] in ("allow", "block")


def test_many_rules_are_joined_with_the_same_result(spark, monkeypatch):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(URLS)], "page_id long, url string")
    rules = [*u.RULES, u.Rule("block", "com", "/"), u.Rule("allow", "com", "/en/"), u.Rule("block", "x.net", "/"), u.Rule("allow", "net", "/es")]
    want = sorted(map(tuple, u.judge(rows, u.Model(None, -1.0, ()), rules).collect()), key=str)
    monkeypatch.setattr(u, "COMPILED_RULES", 0)
    assert sorted(map(tuple, u.judge(rows, u.Model(None, -1.0, ()), rules).collect()), key=str) == want
    many = [*rules, *(u.Rule("block", f"never{k}.org", "/") for k in range(600))]
    assert sorted(map(tuple, u.judge(rows, u.Model(None, -1.0, ()), many).collect()), key=str) == want


def test_a_repeated_url_counts_once(spark):
    labels = [(f"http://site{k}.org/{'x/' * (k % 8)}{k}", k % 8 > 3) for k in range(1500)]
    once = spark.createDataFrame(labels + [("http://hot.net/fr/", True)], "url string, blocked boolean")
    hot = once.union(spark.range(100_000).selectExpr("'http://hot.net/fr/'", "true"))
    a, b = u.train(once), u.train(hot)
    assert a.trees and (a.prior, a.trees) == (b.prior, b.trees)
    assert sorted(map(tuple, a.suffixes.collect())) == sorted(map(tuple, b.suffixes.collect()))


def test_the_sample_is_bounded_and_suffixes_count_everything(spark):
    rows = spark.range(4000).selectExpr("concat('http://h', id, if(id % 4 = 0, '.com', '.org'), '/') AS url", "id % 3 = 0 AS blocked")
    seen = []
    real = u.boost
    try:
        u.boost = lambda x, y, **o: seen.append(len(y)) or real(x, y, **o)
        model = u.train(rows, sample_rows=500)
    finally:
        u.boost = real
    assert 400 < seen[0] < 600
    n = [(sum(k % 3 == 0 for k in range(4000) if (k % 4 == 0) == com), sum((k % 4 == 0) == com for k in range(4000))) for com in (True, False)]
    share = sum(b for b, _ in n) / 4000
    want = {s: round(math.log((b + 4 * share) / (t - b + 4 * (1 - share))) - math.log(share / (1 - share)), 6) for s, (b, t) in zip(("com", "org"), n, strict=True)}
    assert {r["suffix"]: r["odds"] for r in model.suffixes.collect()} == want


def labels_by_suffix():
    """Suffixes whose labels are all of one kind, one of both kinds by depth, and one of both by chance; 46 % are blocked."""
    rng = np.random.default_rng(5)
    out = []
    for k in range(3000):
        suffix, depth = ("aa", "bb", "cc", "dd")[k % 4], int(rng.integers(0, 8))
        blocked = {"aa": True, "bb": False, "cc": depth > 4, "dd": bool(rng.random() < 0.5)}[suffix]
        out.append((f"http://site{rng.integers(10**5)}.{suffix}/{'x/' * depth}{rng.integers(10**6)}", blocked))
    return out


def test_suffixes_of_one_kind_are_told_and_unseen_ones_get_the_prior(spark):
    rows = labels_by_suffix()
    model = u.train(spark.createDataFrame(rows, "url string, blocked boolean"))
    asked = [(k, url.replace(".aa/", f".{s}/")) for k, (url, _) in enumerate(rows[:800]) if ".aa/" in url for s in ("aa", "bb", "zz")] + [(-1, None), (-2, "no host here"), (-3, "http:///path")]
    got = u.judge(spark.createDataFrame(asked, "page_id long, url string"), model, rules=()).collect()
    scores = {s: [r["block_score"] for r in got if r["host"].endswith(s)] for s in (".aa", ".bb", ".zz")}
    share = sum(b for _, b in rows) / len(rows)
    assert abs(model.prior - math.log(share / (1 - share))) < 0.2
    assert min(scores[".aa"]) > 1 and max(scores[".bb"]) < -1
    assert abs(np.mean(scores[".zz"]) - model.prior) < 0.6 and max(scores[".bb"]) < np.mean(scores[".zz"]) < min(scores[".aa"])
    assert {r["block_score"] for r in got if r["host"] == ""} == {model.prior}


def test_held_out_urls_beat_the_majority_where_features_tell(spark):
    """No constant verdict by suffix can reach this: depth decides within one suffix."""
    rows = spark.createDataFrame(labels_by_suffix(), "url string, blocked boolean").withColumn("fold", F.pmod(F.crc32("url"), F.lit(3)))
    model = u.train(rows.filter("fold > 0"))
    got = u.judge(rows.filter("fold = 0"), model, rules=(), keep=("blocked",)).collect()
    for suffix, least in ((".aa", 0.99), (".bb", 0.99), (".cc", 0.95)):
        told = [(r["verdict"] == "block") == r["blocked"] for r in got if r["host"].endswith(suffix)]
        share = np.mean([r["blocked"] for r in got if r["host"].endswith(suffix)])
        assert np.mean(told) >= least and (suffix != ".cc" or np.mean(told) > max(share, 1 - share) + 0.2)


def test_suffixes_without_labels_on_the_pages(spark):
    """.org has no labels there: its URLs are judged about as URLs at large, far from those of .net, all of whose labels are blocked."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = u.train(u.labelled_by_rules(pages))
    scores = u.judge(pages, model).withColumn("suffix", u.suffix_of(F.col("host"))).groupBy("suffix").agg(F.avg("block_score").alias("s"), F.countDistinct("block_score").alias("n")).collect()
    told = {r["suffix"]: r["s"] for r in scores}
    print(told, model.prior)
    assert abs(told["org"] - model.prior) < 0.3 and told["net"] > told["org"] + 1


def plain_tree(values, grad, hess, rows, cuts, depth, rate):
    """The split of largest gain by trying every feature and cut on plain lists."""
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for f in range(len(cuts)):
            for cut in cuts[f]:
                low = [i for i in rows if values[i][f] <= cut]
                lg, lh = sum(grad[i] for i in low), sum(hess[i] for i in low)
                gain = lg**2 / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g**2 / (h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    if best[1] is None:
        return -rate * g / (h + 1)
    _, f, cut = best
    sides = [[i for i in rows if (values[i][f] <= cut) == low] for low in (True, False)]
    return (u.FEATURES[f], cut, *(plain_tree(values, grad, hess, side, cuts, depth - 1, rate) for side in sides))


def walk(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[u.FEATURES.index(node[0])] <= node[1] else node[3]
    return node


def test_trees_are_those_of_plain_search():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 12, (150, len(u.FEATURES))).astype(float)
    blocked = (values[:, 2] + values[:, 4] > 12).astype(float)
    prior, trees = u.boost(values, blocked, n_trees=3, depth=2)
    cuts = [sorted(set(values[:, f]))[:-1] for f in range(values.shape[1])]
    assert abs(prior - math.log((blocked.sum() + 1) / (len(blocked) - blocked.sum() + 1))) < 1e-9
    score = [prior] * len(blocked)
    for tree in trees:
        p = [1 / (1 + math.exp(-x)) for x in score]
        want = plain_tree(values.tolist(), [a - b for a, b in zip(p, blocked, strict=True)], [a * (1 - a) for a in p], range(len(blocked)), cuts, 2, 0.4)
        leaves = [walk(tree, row) for row in values]
        assert np.allclose(leaves, [walk(want, row) for row in values])
        score = [a + b for a, b in zip(score, leaves, strict=True)]


def test_held_out_urls_of_every_suffix(spark):
    """URLs that the rules decide, learnt from two thirds and told for the rest, without the rules."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = u.labelled_by_rules(pages).withColumn("fold", F.pmod(F.crc32("url"), F.lit(3)))
    model = u.train(labelled.filter("fold > 0"))
    rest = labelled.filter("fold = 0").withColumn("suffix", u.suffix_of(u.host_of(F.col("url"))))
    got = u.judge(rest, model, rules=(), keep=("blocked", "suffix")).collect()
    right, blocked = {}, {}
    for r in got:
        right.setdefault(r["suffix"], []).append((r["verdict"] == "block") == r["blocked"])
        blocked.setdefault(r["suffix"], []).append(r["blocked"])
    # the rules go by the path's language, which no feature tells; README gives these figures
    assert set(right) == {"com", "net"} and len(right["com"]) > 200
    for suffix, told in right.items():
        share = np.mean(blocked[suffix])
        assert np.mean(told) >= max(share, 1 - share) - 0.02, (suffix, np.mean(told), share)
