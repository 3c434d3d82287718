"""op2, op3 and op10 against plain Python versions on awkward and random texts."""

import hashlib
import math
import random
import re

import duckdb
import pytest

from lexiforge.llm import licences, personal, secrets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mixed(spark, parts, n=1200, seed=4, most=9):
    r = random.Random(seed)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, most))) for _ in range(n)]
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_personal(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal(spark):
    parts = ["a@b.c", "x.y+z@q-1.com", "_d@e.f", "@", "a@@b.c", "1.2.3.4", "255.256.1.1", "0001.2.3.04.5", "0.0.0.0", " ", "4111 1111 1111 1111", "4111-1111-1111-1111-5", "+1 (743) 555-3824", "+", "12 34 5678", "-", "é😀", "x", "5500000000000004", "..", "\n", "K"]
    texts = [*mixed(spark, parts), None, "", "1 " * 9000, "a@" + "b." * 9000 + "c", "9" * 9000, "+" + "1" * 9000]
    rows = {r.doc_id: r for r in personal.scan_personal(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = base_personal(t or "")
        assert rows[i].base_sha256 == sha(base)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))


def test_personal_adds_checked_numbers(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 x", "iban GB83 WEST 1234 5698 7654 32 x", "ssn 123-45-6789", "code 123-45-6789", "ssn 000-45-6789"]
    rows = {r.doc_id: r.spans for r in personal.scan_personal(frame(spark, texts)).collect()}
    assert rows == {0: "iban:5:32", 1: "", 2: "ssn:4:15", 3: "", 4: ""}


def test_masking(spark, hard):
    texts = ["mail a@b.co or +1 (743) 555-3824.", "none", None, "😀 1.2.3.4 and a@b.co"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in personal.masked(docs).collect()}
    assert [rows[i].text for i in range(4)] == ["mail <EMAIL> or <PHONE>.", "none", None, "😀 <IP> and <EMAIL>"] and rows[0].n_chars == len(rows[0].text)
    assert personal.masked(hard).count() == hard.count()


def base_secrets(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_secrets(spark):
    parts = ["password=", "Token : '", "api_key=", "abc123", "AKIA", "ABCDEFGHIJ12345678", "0123456789abcdef01234567", " ", "é", "x", "=", "tok", "en:", "ſecret=abcdef", "a7Fz9Qp2LmX4Tr8Vw1Bn", "\n"]
    texts = [*mixed(spark, parts), None, "", "ab" * 30000, "=" * 5000]
    rows = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = base_secrets(t or "")
        assert rows[i].base_sha256 == sha(base), t
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set((rows[i].spans or "").split(","))


def test_entropy_windows_by_hand():
    r = random.Random(2)
    s = "".join(r.choice("abcAB01") for _ in range(90))
    want = []
    for i in range(len(s) - 19):
        w = s[i : i + 20]
        want.append(-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)))
    assert secrets.entropy_windows(s) == pytest.approx(want)


def slow_entropy_spans(t, allow, min_bits):
    """Every window of every candidate counted anew, every place marked one by one."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        s = m[0]
        if any(re.fullmatch(p, s, re.I | re.A) for p in allow.wholes):
            continue
        shut = set()
        for p in allow.inside:
            for x in re.finditer(p, s, re.I | re.A):
                shut |= set(range(*x.span()))
        for x in re.finditer("|".join(allow.words), s, re.I | re.A):
            a, b = x.span()
            while a and s[a - 1] not in "+/_=-":
                a -= 1
            while b < len(s) and s[b] not in "+/_=-":
                b += 1
            shut |= set(range(a, b)) if b - a <= 64 else set(range(*x.span()))
        kinds = {"hex"} if all(c in "0123456789abcdefABCDEF" for c in s) else None
        digit, lower, upper = (any(c in a for c in s) for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        name = "hex" if kinds else "letters" if not digit else "base64" if lower and upper else "lower" if lower else "upper" if upper else "digits"
        hot = set()
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            bits = -sum(n / 20 * math.log2(n / 20) for n in map(w.count, set(w)))
            if bits >= min_bits[name] - 1e-9 and not shut & set(range(i, i + 20)):
                hot |= {(i, i + 20)}
        spans = []
        for a, b in sorted(hot):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        out += [(m.start() + a, m.start() + b) for a, b in spans]
    return out


def test_entropy_spans_by_brute_force(spark):
    parts = ["a7Fz9Qp2LmX4", "Tr8Vw1BnC3dK", "test", "-", "/", "example", "0123456789abcdef", "123e4567-e89b-12d3-a456-426614174000", " ", "QWERTZUIOP", "zzzz", "98765", "token=", "AKIA", "é", "k3j5h6g7f8d9"]
    texts = mixed(spark, parts, 800, 11, 14)
    rows = {r.doc_id: set(r.spans.split(",")) for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = base_secrets(t)
        more = {f"entropy:{a}:{b}" for a, b in slow_entropy_spans(t, secrets.AllowList(), secrets.MIN_BITS) if not any(x <= a and b <= y for _, x, y in base)}
        assert {x for x in rows[i] if x.startswith("entropy")} == more, t


def grows_linearly(spark, scan, text):
    """Whether twice the text takes about twice as long, not four times."""
    import time

    def seconds(n):
        one = spark.createDataFrame([(1, text * n)], "doc_id long, text string")
        scan(one).collect()
        t = time.perf_counter()
        scan(one).collect()
        return time.perf_counter() - t

    return seconds(8000) < 3.2 * seconds(4000) + 0.5 and seconds(32000) < 12


def test_time_grows_with_spans(spark):
    assert grows_linearly(spark, secrets.scan_secrets, "token=abcdefg1 a7Fz9Qp2LmX4Tr8Vw1BnC3 ")
    assert grows_linearly(spark, personal.scan_personal, "write to a.b@c.de or 1.2.3.4 ")
    assert grows_linearly(spark, personal.masked, "write to a.b@c.de or 1.2.3.4 ")


def test_many_spans_are_masked(spark):
    n = 5000
    text = "".join(f"x{i} a{i}@b.co é 1.2.3.{i % 256} " for i in range(n))
    row = personal.masked(spark.createDataFrame([(1, text, "u")], "doc_id long, text string, mark string")).first()
    assert row.text == "".join(f"x{i} <EMAIL> é <IP> " for i in range(n)) and row.mark == "u"


def test_overlapping_spans_are_masked_once(spark):
    texts = ["+49 1.2.3.4 5678 end", "a@1.2.3.4 b"]
    rows = {r.doc_id: r.text for r in personal.masked(frame(spark, texts)).collect()}
    assert rows[0] == "<PHONE> end" and rows[1] == "<EMAIL> b"


def test_entropy_spans(spark):
    texts = ["key a7Fz9Qp2LmX4Tr8Vw1BnC3 end", "id 123e4567-e89b-12d3-a456-426614174000 end", "a-very-long-joined-list-of-words here", "Example9Qp2LmX4Tr8Vw1BnC3Ex"]
    rows = {r.doc_id: r.n_entropy for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    assert rows == {0: 1, 1: 0, 2: 0, 3: 0}


def test_licences(spark):
    lines = ["Released under the MIT License. ", "CC BY ", "cc-by nc 4 0 licensed under ", "All Rights Reserved", "the GNU General Public License version 3 this work is licensed ", "word " * 40, "é\n", "permission is hereby granted free of charge to any person obtaining a copy of this ", "K", "cc", " ", "İ by "]
    texts = [*mixed(spark, lines, 400), None, "", "cc by " * 300]
    docs = frame(spark, texts)
    got = docs.sparkSession.createDataFrame(licences.scan_licences(docs).toPandas()).toPandas()
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.register("documents", documents)
    want = con.execute(licences.oracle()).fetchdf()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), -1).to_numpy().tolist()))
    assert key(got) == key(want)
    assert got.labels.str.contains("mit").any()


def slow_licences(text, templates, threshold):
    """Every block of every class against every template, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
    labels = set()
    for label, t in templates:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        size = 8
        while size < len(own):
            size *= 2
        own = set(zip(own, own[1:]))
        for s in range(0, len(words), size):
            block = words[s : s + 2 * size]
            if len(own & set(zip(block, block[1:]))) >= math.ceil(threshold * len(own) - 1e-9):
                labels.add(label)
    return ",".join(sorted(labels))


def test_whole_licences(spark, monkeypatch):
    """Templates of every length, texts longer than a piece, licences with words changed, cut short, shuffled."""
    r = random.Random(3)
    long = [("long", " ".join(f"clause{i % 700} of{i}" for i in range(1500)))]
    templates = [*licences.TEMPLATES, *long]
    texts = []
    for label, t in templates:
        w = t.split()
        some = list(w)
        for _ in range(len(w) // 20):
            some[r.randrange(len(w))] = "other"
        shuffled = r.sample(w, len(w))
        filler = ["filler"] * r.randint(0, 300)
        texts += [" ".join([*filler, *w, *filler]), " ".join(filler + some), " ".join(w[: len(w) // 2]), " ".join(shuffled), " ".join(filler * 40 + w)]
    rows = {x.doc_id: x.labels for x in licences.scan_licences(frame(spark, texts), templates, phrases=()).collect()}
    want = {i: slow_licences(t, templates, 0.8) for i, t in enumerate(texts)}
    assert rows == want and {label for label, _ in templates} <= set(",".join(want.values()).split(","))
    monkeypatch.setattr(licences, "PIECE", 64)
    assert {x.doc_id: x.labels for x in licences.scan_licences(frame(spark, texts), templates[:-1], phrases=()).collect()} == {i: slow_licences(t, templates[:-1], 0.8) for i, t in enumerate(texts)}


def test_licences_are_told_apart(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "Released under the GPL license", "Licensed under the GNU General Public License version 2.0", "cc nc by under licensed 0 4"]
    rows = {x.doc_id: x.labels for x in licences.scan_licences(frame(spark, texts)).collect()}
    assert rows == {0: "cc-by,cc-by-nc", 1: "cc-by", 2: "", 3: "gpl", 4: ""}  # the first holds the phrase "cc by"
    assert licences.scan_licences(frame(spark, texts), templates=()).where("labels <> base_labels").isEmpty()


def test_no_crash_on_hard_rows(spark, hard, empty):
    for scan in (licences.scan_licences, secrets.scan_secrets, personal.scan_personal):
        assert scan(hard).count() == hard.count() and scan(empty).count() == 0


def test_ibans_end_where_their_country_says(spark):
    number = "DE89 3704 0044 0532 0130 00"
    texts = [f"IBAN {number} BIC COBADEFFXXX", "DE89370400440532013000 2024", f"AB12 3456 7890 1234 {number} X"]
    rows = {r.doc_id: r.spans for r in personal.scan_personal(frame(spark, texts)).collect()}
    assert rows == {0: "iban:5:32", 1: "iban:0:22", 2: "iban:20:47"}
    assert personal.masked(frame(spark, texts)).where("doc_id = 0").first().text == "IBAN <IBAN> BIC COBADEFFXXX"


def test_entropy_of_every_class(spark):
    r = random.Random(9)
    keys = ["".join(r.choice(a) for _ in range(32)) for a in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(200)]
    block = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400))
    texts = [*keys, "src/tests/a7Fz9Qp2LmX4Tr8Vw1BnC3", block[:200] + "test" + block[200:], "unit/sample/placeholder-1"]
    n = [x.n_entropy for x in sorted(secrets.scan_secrets(frame(spark, texts)).collect(), key=lambda x: x.doc_id)]
    assert sum(map(bool, n[:200])) > 180 and sum(map(bool, n[200:400])) > 170
    assert n[400] and n[401] and not n[402]
