import math
import re
from collections import Counter
from itertools import combinations

from rawframe.llm import url_filter


def pages():
    words = ["cheap", "deals", "news", "daily", "win", "casino", "the", "house", "garden"]
    out = []
    for k in range(160):
        name = words[k % 9] + words[k * 5 % 7]
        host = ["", "www.", "m.", "WWW."][k % 4] + name + "." + ["Example.com", "example.net", "example.org", "other.org"][k % 3 if k % 5 else 3]
        out.append((k, f"http{'s' * (k % 2)}://{host}/{['en', 'es', 'fr', 'de'][k % 4]}/{k}{['', '/', '.html', '?a=/fr/', '#top'][k % 5]}", f"<p class='x'>{' '.join(words[: k % 9 + 1])}</p> Deals-News"))
    odd = [None, "", "no address", "://", "x://com", "x://COM/", "x://notcom/", "http://example.com/en", "http://example.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/1", "HTTP://A.NET/es/?q", "http://net/fr/a#b",
           "http://example.com:80/en/", "http://" + "casinowin" * 40 + ".org/x", "a://b://c/d", "http://h.org\n.com/x\ny?z"]
    return out + [(1000 + k, u, None) for k, u in enumerate(odd)] + [(None, "http://thehouse.org/en/7", "thehouse"), (5, out[5][1], out[5][2])]


def parts(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def expected(rows):
    counts = Counter(w for _, _, html in rows for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").lower()) if 2 <= len(w) <= 24)
    total = sum(counts.values())
    price = lambda w: round(-math.log(counts[w] / total) * 10**6) if counts[w] else url_filter.unknown_cost(len(w), total)

    def cut(run):
        best = {0: (0, 0, 0, [])}
        for end in range(1, len(run) + 1):
            best[end] = min((best[s][0] + price(run[s:end]), best[s][1] + 1, s, [*best[s][3], run[s:end]]) for s in range(max(0, end - 24), end))
        return best[len(run)][3]

    known = {}
    judged = []
    for key, url, _ in rows:
        host, path = parts(url)
        if host not in known:
            known[host] = [w for run in re.findall("[a-z]+", host) for w in cut(run)]
        tokens = ["h:" + w for w in known[host]] + ["p:" + w for w in re.findall("[a-z]+|#", re.sub("[0-9]+", "#", "".join(c.lower() if c.isascii() else c for c in path)))]
        judged.append((key, host, path, *rule_of(host, path), tokens, " ".join(known[host])))
    seen = {v: Counter(t for j in judged if j[4] == v for t in j[5]) for v in ("block", "allow")}
    kinds = len(seen["block"] | seen["allow"])
    n = {v: sum(j[4] == v for j in judged) + 1 for v in seen}
    prior = round((math.log(n["block"]) - math.log(n["allow"])) * 10**6)
    log = lambda v, t: math.log((seen[v][t] + 1) / max(1, sum(seen[v].values()) + kinds))
    out = []
    for key, host, path, rule, verdict, tokens, words in judged:
        score = None if rule else prior + sum(round((log("block", t) - log("allow", t)) * 10**6) for t in tokens if seen["block"][t] or seen["allow"][t])
        out.append((key, host, path, rule, verdict or ("block" if score > 0 else "allow"), score, words))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_against_loops(spark):
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    made = url_filter.filtered(table).select("row.page_id", "host", "path", "rule", "verdict", "score", "host_words").collect()
    assert order(map(tuple, made)) == order(expected(rows))
    free = [r for r in made if r["rule"] is None]
    assert {r["verdict"] for r in free} == {"block", "allow"} and len({r["rule"] for r in made}) == 6


def test_cut_is_the_cheapest_of_all():
    costs = {(0, 3): 5, (3, 2): 4, (0, 2): 4, (2, 3): 5, (1, 4): 2}
    total = 50
    run = "abcde"
    found = url_filter.best_cut(run, costs, total)

    def price(words):
        at, out = 0, 0
        for w in words:
            out += costs.get((at, len(w)), url_filter.unknown_cost(len(w), total))
            at += len(w)
        return out

    cuts = [[run[i:j] for i, j in zip((0, *c), (*c, 5))] for k in range(5) for c in combinations(range(1, 5), k)]
    assert price(found) == min(map(price, cuts))
    assert found == ["ab", "cde"]  # as dear as abc, de: the longer last word is taken


def test_without_rules_and_rows(spark):
    rows = pages()[:20]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_filter.filtered(table, rules=()).collect()
    assert len(out) == 20 and all(r["verdict"] == "allow" and r["score"] == 0 and r["rule"] is None for r in out)
    assert url_filter.filtered(table.limit(0)).count() == 0


def test_other_columns(spark):
    rows = [(1, "http://a.net/es/1", None, "x", 2), (2, "http://ab.org/", "ab", None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, score int")
    out = {r["row"]["page_id"]: r for r in url_filter.filtered(table).collect()}
    assert out[1]["row"]["host"] == "x" and out[1]["host"] == "a.net" and out[1]["row"]["score"] == 2
    assert out[2]["host_words"] == "ab o r g" and out[1]["verdict"] == "block"
