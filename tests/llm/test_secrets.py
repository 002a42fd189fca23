"""Secrets against plain regular expressions, the query's SQL and planted tokens."""

import hashlib
import random
import re
import zlib

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)


def token(prefix, body, wrong=False):
    n, out = zlib.crc32(body.encode()) ^ wrong, ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = DIGITS[k] + out
    return prefix + body + out


def checked(m):
    return len(m[1]) == 36 and token("", m[1][:30]) == m[1]


def brute(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found += [(m.start(), 3, m.end(), "github") for m in re.finditer("gh[pousr]_([0-9A-Za-z]+)", text) if checked(m)]
    found += [(m.start(), 4, m.end(), "npm") for m in re.finditer("npm_([0-9A-Za-z]+)", text) if checked(m)]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def texts():
    r = random.Random(5)
    body = "".join(r.choice(DIGITS) for _ in range(30))
    parts = ["token", "TOKEN", "Secret", "api_key", "apikey", "passwd", "password", "pass", "=", ":", " = ", '"', "'", '": "', "AKIA", "akia", "A", "Z9", "0123456789abcdef", "f", "ab" * 9, "é", "ſecret=", "toKen=", "中", "12345678", "x.y/z+w-", " ", "\n", "g", "ghp_", "npm_"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(800)]
    planted = [token("ghp_", body), token("npm_", body), token("gho_", body, True), token("npm_", body) + "x", "é" + token("ghs_", body) + " token=" + token("ghr_", body)]
    edges = ["AKIA" + "B" * 11, "AKIA" + "B" * 12, "AKIAAKIA" + "B" * 12, "a" * 31, "a" * 32, "x" * 15 + "a" * 32, "token=1234567", "token=12345678", "token=password=abcdefgh", "token = = 12345678", "token  :   'abcdefgh'"]
    return made + planted + edges + ["", None, "é" * 70_000 + " secret: abcdefgh " + "0" * 100_000]


def test_spans_match_plain_expressions_and_sql(spark, docs_of, tmp_path):
    import duckdb

    from millrace.llm import queries
    from millrace.llm.secret_scan import find_secrets

    made = texts()
    docs = docs_of([*made, *made[:3]], [*range(len(made) - 1), None, 0, 1, 2])
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    got = sorted(((r["doc_id"], [(x["kind"], x["start"], x["end"]) for x in r["spans"]]) for r in find_secrets(spark, docs).collect()), key=key)
    want = sorted([(k if k < len(made) - 1 else None, brute(t or "")) for k, t in enumerate(made)] + [(k, brute(made[k])) for k in range(3)], key=key)
    assert got == want
    assert {kind for _, found in want for kind, _, _ in found} == {"assign", "access", "hex", "github", "npm"}

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in queries.op12_secret_scan(spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = c.sql(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(rows, key=key) == sorted(sql, key=key)
    for doc_id, a, b, n, digest, spans in rows:
        own = [x for x in spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        assert digest == hashlib.sha256(",".join(own).encode()).hexdigest() and a + b + n == len([x for x in own if x])


def test_empty_table(spark, docs_of):
    from millrace.llm.secret_scan import find_secrets

    assert find_secrets(spark, docs_of([])).collect() == []
