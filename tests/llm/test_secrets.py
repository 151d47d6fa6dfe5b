import random
import re

from rawframe.llm import secrets as S


def brute(text):
    out = []
    rules = [
        (0, "assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (1, "access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (2, "hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
        (3, "private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", bool),
        (4, "bearer", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}", bool),
        (5, "hosting", r"gh[pousr]_[A-Za-z0-9]{36,}", bool),
    ]
    for rank, kind, pattern, test in rules:
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if test(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def texts():
    rng = random.Random(2)
    bits = ["password", "PassWD", "ſecret", "secret", "toKen", "toen", "api_key", "APIKEY", '"', " ", "  ", ":", "=", "abcdefABCDEF01", "é", "0123456789abcdef", "AKIA", "ABCDEF0123456789", "\n", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx", "ghp_" + "a1" * 18, "🙂", "x" * 50]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)] + [None, "", "pa", "to", "ken", "AK"]


def test_against_brute_force(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    got = {r["row"]["doc_id"]: r["j"] for r in S.scan_secrets(docs).select("row", S.joined("spans").alias("j")).collect()}
    assert got == {k: brute(t) for k, t, _ in rows}
    assert S.scan_secrets(docs.limit(0)).count() == 0


def test_queries():
    assert S.trigram_query("abcd") == ("and", (b"abc", b"bcd"))
    assert S.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert S.trigram_query("[0-9a-f]+") is S.ALWAYS
    assert S.trigram_query("(abc|de)x*") is S.ALWAYS
    assert S.trigram_query("(abc|def)+") == ("or", (b"abc", b"def"))
    assert S.trigram_query("a(b|c)d") == ("or", (b"abd", b"acd"))
    assert S.trigram_query("(?:foo)?bar") == ("or", (b"bar", ("and", (b"foo", b"oob", b"oba", b"bar"))))
    assert S.trigram_query(S.BASE[0].pattern) is not S.ALWAYS
