"""The path-template tree against a plain version over dictionaries."""

import random
import re
from collections import defaultdict
from math import sqrt

import pytest

from sparkwire.llm import urls
from sparkwire.llm.queries import URL_RULES, queries
from sparkwire.llm.scratch import Scratch


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.rule), default=None)
    return (best.rule, best.verdict) if best else (None, None)


def plain(all_urls, tree=urls.Tree()):
    """{(host, path): (template, purity)}"""
    k = tree.prior_weight
    smooth = lambda bad, seen, prior: (bad + k * prior) / (seen + k)
    rows = {}
    for u in all_urls:
        host, path = parts(u)
        _, verdict = ruled(host, path)
        r = rows.setdefault((host, path), {"n": 0, "bad": 0, "seen": 0, "template": ""})
        r["n"] += 1
        r["bad"] += verdict == "block"
        r["seen"] += verdict is not None
    overall = (sum(r["bad"] for r in rows.values()) + 1) / (sum(r["seen"] for r in rows.values()) + 2)
    for (_, path), r in rows.items():
        whole = [s for s in path.split("/") if s]
        r["segs"] = ["#" if re.search("[0-9]", s) else s for s in whole][: tree.depth]
        r["deep"] = len(whole) > tree.depth

    def sums(key):
        out = defaultdict(lambda: [0, 0, 0])
        for x, r in rows.items():
            for j, c in enumerate(("n", "bad", "seen")):
                out[key(x, r)][j] += r[c]
        return out

    for level in range(tree.depth):
        for r in rows.values():
            r["seg"] = r["segs"][level] if level < len(r["segs"]) else ""
        prior = {x: smooth(bad, seen, overall) for x, (_, bad, seen) in sums(lambda x, r: (r["template"], r["seg"])).items()}
        below = defaultdict(dict)
        for (host, template, seg), v in sums(lambda x, r: (x[0], r["template"], r["seg"])).items():
            below[host, template][seg] = v
        token = {}
        for (host, template), there in below.items():
            variable = len(there) >= tree.many_children and len(there) >= tree.child_share * sum(v[0] for v in there.values())
            literal = sorted((smooth(bad, seen, prior[template, s]), s, seen + k) for s, (_, bad, seen) in there.items() if s not in ("", "#"))
            branches = []
            for p, s, n in literal:
                if branches:
                    last_p, last_n = branches[-1][-1][0], branches[-1][-1][2]
                    mid = (p + last_p) / 2
                if not branches or p - last_p > tree.merge_z * sqrt(mid * (1 - mid) * (1 / n + 1 / last_n)):
                    branches.append([])
                branches[-1].append((p, s, n))
            for b in branches:
                names = [s for _, s, _ in b]
                for s in names:
                    token[host, template, s] = "*" if variable else min(names) + (f"|+{len(names) - 1}" if len(names) > 1 else "")
            token |= {(host, template, s): s for s in there if s in ("", "#")}
        for (host, _), r in rows.items():
            if level == 0:
                r["first"] = prior["", r["seg"]]
            if r["seg"]:
                r["template"] += "/" + token[host, r["template"], r["seg"]]
    for r in rows.values():
        r["template"] += "/**" if r["deep"] else ""
    leaf = defaultdict(lambda: [0, 0, 0.0, 0])
    for (host, _), r in rows.items():
        for j, v in enumerate((r["bad"], r["seen"], r["first"] * r["n"], r["n"])):
            leaf[host, r["template"]][j] += v
    return {x: (r["template"], smooth(*(v := leaf[x[0], r["template"]])[:2], v[2] / v[3])) for x, r in rows.items()}


def random_urls(seed, n=900):
    r = random.Random(seed)
    hosts = ["a.example.org", "example.org", "b.example.com", "Shop.Example.NET", "news.example.net", "x.example.net", "example.com"]
    words = ["es", "en", "fr", "de", "p", "tag", "post", "über"] + [f"slug-{chr(97 + i)}" for i in range(24)]
    out = [None, "", "no scheme", "http://", "http://example.org", "https://example.org//es//1", "http://x.example.net/" + "a/" * 9, "http://x.example.net/" + "long" * 20000]
    for _ in range(n):
        deep = [r.choice(words[:5])] + [r.choice([*words, "12", "a1", str(r.randrange(999))]) for _ in range(r.choice([0, 1, 1, 2, 3, 5]))]
        out.append(f"http://{r.choice(hosts)}/{'/'.join(deep)}{r.choice(['', '/', '?q=1', '#top'])}")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts(spark, seed):
    all_urls = random_urls(seed) + ["http://a.example.org/en/1"] * 30
    df = spark.createDataFrame([(i % 700, u, "clash") for i, u in enumerate(all_urls)], "page_id long, url string, template string").repartition(4)
    got = urls.judge(df, Scratch(spark, "t"), URL_RULES).collect()
    want = plain(all_urls)
    assert len(got) == len(all_urls) and len({t for t, _ in want.values()}) > 60
    seen = set()
    for g in got:
        template, purity = want[g["host"], g["path"]]
        rule, verdict = ruled(g["host"], g["path"])
        assert (g["template"], g["rule"]) == (template, rule) and abs(g["purity"] - purity) < 1e-9
        assert g["verdict"] == (verdict or ("block" if purity >= 0.5 else "allow"))
        seen.add((rule is None, g["verdict"]))
    assert len(seen) == 4


def test_query(spark, tmp_path):
    all_urls = random_urls(3, 200)
    spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(all_urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {g["page_id"]: (g["host"], g["path"], g["rule"]) for g in queries()["op4_url_templates"](spark, str(tmp_path)).collect()}
    assert got == {i: (*parts(u), ruled(*parts(u))[0]) for i, u in enumerate(all_urls)}
