import hashlib
import re
from collections import Counter

from tessera.llm.secret_scan import KINDS, REACH, STRONG, op5_secret_scan, scan

BASE = {
    "assign": (re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}
WEAK = {
    "weak_id": (re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,32}(?![A-Za-z0-9])"), lambda m: re.search("[0-9]", m)),
    "weak_secret": (re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,64}=?(?![A-Za-z0-9+/=])"), lambda m: re.search("[0-9]", m)),
    "endpoint": (re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"), lambda m: len(m) >= 8),
}
ORDER = list(KINDS)


def base(text):
    spans = [(m.start(), k, m.end()) for k, (p, g, n) in BASE.items() for m in p.finditer(text) if len(m[g]) >= n]
    return sorted(spans, key=lambda s: (s[0], ORDER.index(s[1])))


def brute(text):
    strong = base(text or "")
    weak = [(m.start(), k, m.end()) for k, (p, ok) in WEAK.items() for m in p.finditer(text or "") if ok(m[0])]
    every = strong + weak
    role = {k: v[3] for k, v in KINDS.items()}
    out = list(strong)
    for s, k, e in weak:
        near = {role[x] for t, x, _ in every if abs(t - s) <= REACH}
        good = {"id": "secret" in near, "secret": bool({"id", "endpoint"} & near), "endpoint": {"id", "secret"} <= near}[role[k]]
        if good and not any(t < e and s < f for t, _, f in strong):
            out.append((s, k, e))
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[1])))


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def test_query_matches_brute_force(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_secret_scan(spark, sf)
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r.doc_id])
        n = Counter(k for _, k, _ in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [n[k] for k in STRONG]
        assert r.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest()
        assert r.spans == told(brute(docs[r.doc_id]))
    assert any(r.spans for r in rows)
    assert not any(re.search("Python|Arrow|Pandas", x) for x in got._jdf.queryExecution().toString().splitlines())


ID, KEY = "QWERTY1234ASDFGH5678", "abcdEFGH1234ijklMNOP5678qrstUVWX9012yzAB"
CASES = [
    None,
    "",
    f"é漢 {ID} then {KEY} at https://db.example.com:5432/x",
    f"{ID} alone",
    f"{KEY} alone",
    f"{ID}{' ' * 300}{KEY}",
    f"https://h.example {KEY}",
    f"https://h.example {ID}",
    f"PassWord = 'abcdefgh' token=secret: abcdefgh12 API_KEY:short api-key=abcdefghijk apikey\"=\"{KEY}",
    f"AKIA{ID} AKIAABC AKIA{'A' * 12} xAKIA{'B' * 15}y",
    "0123456789abcdef" * 2 + " " + "0" * 31 + "\n" + "f" * 100,
    f"{ID}\n" * 500 + KEY,
    "token=" * 40 + "aaaaaaaa",
]


def test_odd_texts(spark, odd_docs, no_docs):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for rows in (df, odd_docs):
        texts = {r.doc_id: r.text for r in rows.collect()}
        got = scan(rows).collect()
        assert len(got) == rows.count()
        for r in got:
            assert [(s.start, ORDER[s.kind], s.end) for s in r.spans] == brute(texts[r.id]), texts[r.id]
    assert scan(no_docs).count() == 0
