import datetime
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from cairn.llm import decontaminate, packing, pii, quality, queries, tokens, toxicity, warc
from cairn.llm.common import new_path

SF = "/root/testdata/sf0.001"
HARD = ["", None, "END. It'S, (don't)!! a--b; ñandú, É. e\u0301. H\u0331! x&y&&& 12.5, <|ENDOFTEXT|>. <|endoftext|>, \u2014. a\u2014, ...", "one\x0btwo\x0cthree", "a b c\x85d\x1ce", "Ünï ñ don't 12 <|endoftext|> ok", "é ́x ΑΣ", "日本語 テキスト", "word " * 9000, "x" * 3000, "a\tb\r\nc"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe())


def test_word_encoder_is_exact(tokenizer):
    encoder = tokens.WordEncoder(open(queries.word_bpe(), encoding="utf-8").read())
    rng = random.Random(8)
    odd = ["".join(rng.choices("aBz9 \t.,'s't!?#&-<|>_\u2014\u00e9\u00c9\u0301\u0331Hh\u00a0\u0130\u03a3\u4e00\U0001f600", k=rng.randint(1, 40))) for _ in range(3000)]
    texts = [t or "" for t in HARD] * 2 + odd + ["A<|ENDOFTEXT|>.", "x.<|endoftext|>", "END.<|endoftext|> A."]
    for t, ids in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:40]


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = tokens.WordEncoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert not encoder.wordwise and tokens.WordEncoder(open(queries.word_bpe(), encoding="utf-8").read()).wordwise
    for t, ids in zip(HARD, encoder.ids(t or "" for t in HARD), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_blocks_round_trip(planes):
    for n in (0, 1, 7, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32).tobytes()
        assert tokens.from_block(tokens.to_block(ids, planes)) == ids
    with pytest.raises(ValueError):
        block = bytearray(tokens.to_block(b"\1\0\0\0" * 50, planes))
        block[-5:] = tokens.to_block(b"\2\0\0\0" * 50, planes)[-5:]
        block[26 if planes == "byte" else 138] ^= 1
        tokens.from_block(bytes(block))


@pytest.mark.parametrize("planes, block", [("byte", 64), ("bit", 1000)])
def test_ids_are_read_back(spark, tokenizer, planes, block):
    docs = spark.createDataFrame([(i * 7 % 11, t, 5) for i, t in enumerate(HARD)], "doc_id long, text string, start int")
    path = new_path(spark, "ids")
    tokens.write_ids(docs, path, queries.word_bpe(), end_id=2, planes=planes, block=block)
    start = 0
    rows = {r.doc_id: r for r in tokens.read_ids(spark, path, with_ids=True).collect()}
    assert len(rows) == len(HARD)
    for d, t in sorted((i * 7 % 11, t) for i, t in enumerate(HARD)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        assert (rows[d].start, rows[d].n_tokens, bytes(rows[d].ids), rows[d].ids_crc32) == (start, len(ids) // 4, ids, zlib.crc32(ids))
        start += len(ids) // 4
    plain = {r.doc_id: (r.start, r.ids_crc32) for r in tokens.read_ids(spark, path).collect()}
    assert plain == {d: (r.start, r.ids_crc32) for d, r in rows.items()}


def test_ids_of_null_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (3, None)], "doc_id long, text string")
    path = new_path(spark, "ids")
    tokens.write_ids(docs, path, queries.word_bpe())
    rows = sorted(tokens.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 3, 3, 3] and rows[0].start == 0
    path = new_path(spark, "ids")
    tokens.write_ids(docs.limit(0), path, queries.word_bpe())
    assert tokens.read_ids(spark, path).count() == 0


def test_fullest_bin_is_the_fullest():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.randint(5, 40)
        counts = {rng.randint(1, cap): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        used = packing.fullest(counts, cap)
        longest = max(counts)
        items = [k for k, n in counts.items() for _ in range(n - (k == longest))]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= cap - longest}
        assert longest in used and all(used[k] <= counts[k] for k in used)
        assert sum(k * n for k, n in used.items()) == longest + max(sums)


def gapless(rows, cap):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    return len(bins)


def test_packing_of_a_table(spark, tokenizer):
    rows = queries.op9_packing(spark, SF).collect()
    bins = gapless(rows, 4096)
    assert bins <= 1.02 * sum(r.length for r in rows) / 4096 + 1
    docs, by = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}, defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(docs)
    for d, parts in by.items():
        ids = np.array([*tokenizer.encode(docs[d], add_special_tokens=False).ids, 1], dtype="<u4")
        parts.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [
            (k, a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))
        ]


def test_packing_of_hard_rows(spark):
    docs = spark.createDataFrame([(i % 7 or None, t, "x") for i, t in enumerate(HARD * 2)], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, queries.word_bpe(), capacity=64).collect()
    assert gapless(rows, 64) and sum(1 for r in rows if r.piece == 0) == 2 * len(HARD)
    assert packing.pack_documents(docs.limit(0), queries.word_bpe()).count() == 0


def test_archive_keeps_records(spark):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: 1", "<p>é</p>"), (3, None, None), (4, "c", ""), (None, "d", "z"), (None, "e", "z"), (5, "f", "a\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"), (2, "http://b", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, address string")
    path = new_path(spark, "warc")
    warc.write_archive(df, path)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_index(spark, path).collect()), key=str)
    want = [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None), (None, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.read_payloads(spark, path).count() == 4
    records = {r.page_id: r for r in warc.read_records(spark, path).collect()}
    assert bytes(records[1].payload).decode() == "<p>é</p>" and bytes(records[1].record).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert b"http://b%0D%0A" in bytes(records[2].record) or b"http://b\r\n" in bytes(records[2].record)
    assert bytes(records[5].record).endswith(pages[6][2].encode() + b"\r\n\r\n")
    out = new_path(spark, "warc-text")
    warc.export_warc(spark, path, out)
    assert spark.read.option("wholetext", True).text(out).filter(F.col("value").contains("WARC-Target-URI: http://a")).count() >= 1
    path = new_path(spark, "warc")
    warc.write_archive(df.limit(0), path)
    assert warc.read_index(spark, path).count() == 0


def test_damaged_payload_is_an_error(spark):
    path = new_path(spark, "warc")
    spark.createDataFrame([("00", bytearray(b"x"))], "address string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_payloads(spark, path).collect()


def edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontaminate.myers(p, t)[0] == edits(p, t)


@pytest.mark.parametrize("pass_chars", [10_000, 300])
def test_contamination_by_hand(spark, pass_chars):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(12)] + [(50, None), (51, ""), (None, "a lonely item of the test")]
    docs = []
    for d in range(40):
        text = [word() for _ in range(30)]
        if d % 3 == 0:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 6)):
                item[rng.randrange(len(item))] = rng.choice("abcdefgh ")
            text.insert(10, "".join(item).upper() if d % 2 else "".join(item))
        docs.append((d, "  ".join(text), "x"))
    docs += [(90, None, "x"), (None, "so A Lonely\nitem of the test", "x"), (91, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = decontaminate.plain
    want = {(d, i) for d, t, _ in docs for i, x in items if x and edits(plain(x), plain(t or "")) <= decontaminate.budget(plain(x), 0.05)}
    got = {(r.doc_id, i) for r in decontaminate.hits(df, bench, pass_chars=pass_chars).select(F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "item_id").collect() for i in [r.item_id]}
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {d for d, _, _ in docs} - {d for d, _ in want}
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PRIVATE = [
    "card 4111 1111 1111 1111 and 4111111111111112 no", "mail jo.81@mail7.example.com!", "ip 10.0.0.255 not 10.0.0.256", "+1 (017) 555-7713",
    "on 2024-02-29 not 2023-02-30", "on 1.2.2020 and 12/31/1999 and 31/12/1999", "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "nothing at all", "", None, "078-05-1120",
]


def pseudonymised(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_found int")
    return [r.text for r in pii.pseudonymised(df, key).orderBy("doc_id").collect()]


def test_pseudonyms_keep_the_format(spark):
    got = pseudonymised(spark, PRIVATE)
    card = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and 4111111111111112 no", got[0])[1]
    assert luhn(card) and card != "4111 1111 1111 1111"
    assert re.fullmatch(r"mail [a-z]{2}\.\d\d@mail7\.example\.com!", got[1]) and got[1] != PRIVATE[1]
    ip = re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+) not 10\.0\.0\.256", got[2])
    assert all(int(x) < 256 for x in ip.groups()) and got[2] != PRIVATE[2]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[3]) and got[3] != PRIVATE[3]
    day = datetime.date.fromisoformat(re.fullmatch(r"on (\d{4}-\d\d-\d\d) not 2023-02-30", got[4])[1])
    assert day != datetime.date(2024, 2, 29)
    assert re.fullmatch(r"on \d{1,2}\.\d{1,2}\.\d{4} and \d\d/\d\d/\d{4} and \d\d/\d\d/\d{4}", got[5])
    a, b = re.findall(r"(\d\d)/(\d\d)/(\d{4})", got[5])
    assert (a[1], a[0], a[2]) == b  # one day in two layouts
    iban = got[6].replace(" ", "")
    assert iban.startswith("GB") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and got[6] != PRIVATE[6]
    assert got[7:11] == PRIVATE[7:11] and re.fullmatch(r"\d{3}-\d\d-\d{4}", got[11])
    assert pseudonymised(spark, PRIVATE) == got and pseudonymised(spark, PRIVATE, "other")[0] != got[0]


def test_pseudonyms_are_one_to_one(spark):
    ips = [f"x 10.0.{i}.{j} y" for i in range(20) for j in range(20)]
    phones = [f"+1 (555) 010-{i:04d}" for i in range(300)]
    days = [f"20{y:02d}-{m:02d}-11" for y in range(25) for m in range(1, 13)]
    for texts in (ips, phones, days):
        assert len(set(pseudonymised(spark, texts))) == len(texts)


def test_days_are_permuted(spark):
    first, last = datetime.date(1, 1, 1), datetime.date(9999, 12, 31)
    days = [first + datetime.timedelta(n) for n in (*range(0, 145_000, 97), *range((last - first).days - 80_000, (last - first).days + 1, 89))]
    df = spark.createDataFrame([(d.isoformat(),) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    got = [r.m for r in df.select("d", pii.moved_day(F.col("d"), F.lit("k|date")).cast("string").alias("m")).orderBy("d").collect()]
    assert got == [day_by_hand(d, "k|date").isoformat() for d in sorted(days)]
    assert len(set(got)) == len(days) and all(len(x) == 10 for x in got)


def feistel_by_hand(values, radices, key):
    now = list(values)
    for r in range(pii.ROUNDS):
        turn = lambda i: i % 2 == r % 2  # noqa: B023, E731
        rest = ",".join(str(v) for i, v in enumerate(now) if not turn(i))
        hexes = hashlib.sha512(f"{key}|{r}|{rest}".encode()).hexdigest()
        h = lambda i: int(hexes[4 * (i // 2 % 32) :][:4], 16)  # noqa: B023, E731
        now = [(v + h(i)) % radices[i] if turn(i) else v for i, v in enumerate(now)]
    return now


def letters_by_hand(letters, key):
    base = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in letters]
    new = feistel_by_hand([ord(c) - ord(b) for c, b in zip(letters, base)], [10 if b == "0" else 26 for b in base], key)
    return "".join(chr(ord(b) + v) for b, v in zip(base, new))


def relaid_by_hand(text, new):
    it = iter(new)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in text)


def day_by_hand(day, key):
    n, before = (day - datetime.date(1, 1, 1)).days, 72_683
    a, b = (189, 773) if 200 <= day.year < 9800 else (93, 1567)
    p = (n - before) % 146_097 if a == 189 else n if day.year < 200 else n - 24 * 146_097
    x, y = feistel_by_hand([p // b, p % b], [a, b], key)
    q = x * b + y
    new = n - p + q if a == 189 else q if q < before else q + 24 * 146_097
    return datetime.date(1, 1, 1) + datetime.timedelta(new)


def date_by_hand(m, key):
    a, mark, b, _, year = re.match(r"(\d+)([./-])(\d+)([./-])(\d+)", m).groups()
    if len(a) == 4:
        try:
            return day_by_hand(datetime.date.fromisoformat(m), key + "|date").isoformat()
        except ValueError:
            return m
    for d, mo, form in ((a, b, "dm"), (b, a, "md")):
        try:
            new = day_by_hand(datetime.date(int(year), int(mo), int(d)), key + "|date")
        except ValueError:
            continue
        pad = "02d" if len(a) == len(b) == 2 else "d"
        x, y = (new.day, new.month) if form == "dm" else (new.month, new.day)
        return f"{x:{pad}}{mark}{y:{pad}}{mark}{new.year:04d}"
    return m


def address_by_hand(m, key):
    if "@" in m:
        local, host = m.rsplit("@", 1)
        return [(relaid_by_hand(local, letters_by_hand("".join(c for c in local if c.isascii() and c.isalnum()), key + "|email")) + "@" + host, True)]
    return iban_by_hand(m, key, True)


def iban_by_hand(m, key, known=False):
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    for end in range(len(m), 0, -1):
        part = m[:end].replace(" ", "")
        if (end == len(m) or (not known and m[end] == " ")) and 15 <= len(part) <= 34 and number(part[4:] + part[:4]) % 97 == 1:
            rest = letters_by_hand(part[4:], key + "|iban")
            return [(relaid_by_hand(m[:end], f"{part[:2]}{98 - number(rest + part[:2] + '00') % 97:02d}{rest}"), True), (m[end:], False)]
    return [(m, False)]


def phone_by_hand(m, key):
    digits = "".join(c for c in m if c.isdigit())
    code = re.match(pii.COUNTRY, digits)[0]
    end = len(m) if 8 <= len(digits) <= 15 else 0
    if (n := pii.NATIONAL.get(code)) and len(digits) > n + len(code):
        at = [i for i, c in enumerate(m) if c.isdigit()][n + len(code) - 1] + 1
        end = at if not m[at].isdigit() else end
    own = "".join(c for c in m[:end] if c.isdigit())
    return [(relaid_by_hand(m[:end], code + letters_by_hand(own[len(code) :], key + "|phone")), True), (m[end:], False)] if end else [(m, False)]


def run_by_hand(m, key):
    groups = [(g.start(), g.end()) for g in regex.finditer(r"[\p{L}\p{N}]+", re.sub(pii.TAIL + "$", "", m))]
    found = []
    for i, (a, _) in enumerate(groups):
        for n in range(1, 20):
            part = [m[x:y] for x, y in groups[i : i + n]]
            digits = "".join(part)
            if len(part) < n or not re.fullmatch("[0-9]{13,19}", digits) or not luhn(digits):
                continue
            b = groups[i + n - 1][1]
            odd = not re.search(pii.CARD_GROUPS, "-".join(str(len(g)) for g in part))
            inside = {m[groups[k][1] : groups[k + 1][0]] for k in range(i, i + n - 1)}
            if not (odd and (len(inside) > 1 or (i and m[a - 1] == "-") or (i + n < len(groups) and m[b] == "-"))):
                found.append((odd, i, -n, a, b))
    kept = []
    for _, i, n, a, b in sorted(found):
        if not any(j < i - n and i < j + k for j, k, _, _ in kept):
            kept.append((i, -n, a, b))
    out, at = [], 0
    for _, _, a, b in sorted(kept):
        body = letters_by_hand("".join(c for c in m[a:b] if c.isdigit())[:-1], key + "|card")
        out += [(m[at:a], False), (relaid_by_hand(m[a:b], body + next(c for c in "0123456789" if luhn(body + c))), True)]
        at = b
    return [*out, (m[at:], False)]


def small_by_hand(m, key):
    whole = lambda p: regex.fullmatch(p, m)
    if whole(pii.ISO_DATE) or whole(pii.DATE):
        return [(date_by_hand(m, key), True)]
    if whole(pii.IPV4):
        return [(".".join(map(str, feistel_by_hand(list(map(int, m.split("."))), [256] * 4, key + "|ip"))), True)]
    letters = "".join(c for c in m if c.isdigit())
    return [(relaid_by_hand(m, letters_by_hand(letters, key + ("|ssn" if whole(pii.SSN) else "|local_phone"))), True)]


def text_by_hand(text, key):
    pieces = [(text, False)]
    for pattern, replaced in ((pii.ADDRESS, address_by_hand), (pii.OTHER_IBAN, iban_by_hand), (pii.PHONE, phone_by_hand), (pii.RUN, run_by_hand), (pii.SMALL, small_by_hand)):
        found = []
        for t, done in pieces:
            at = 0
            for m in () if done else regex.finditer(pattern, t):
                found += [(t[at : m.start()], False), *replaced(m[0], key)]
                at = m.end()
            found.append((t[at:], done))
        pieces = []
        for t, done in found:
            if pieces and not done and not pieces[-1][1]:
                pieces[-1] = (pieces[-1][0] + t, False)
            else:
                pieces.append((t, done))
    return "".join(t for t, _ in pieces)


CARD, IBAN, SPACED, PHONE = "4111 1111 1111 1111", "BE68539007547034", "AT61 1904 3002 3457 3201", "+44 20 7946 0958"
#: Texts, and the values in them, each of which must get the pseudonym that it gets alone; all else stays.
BESIDE = [
    ("BE68539007547034 EUR", [IBAN]), ("BE68 5390 0754 7034 EUR 50", ["BE68 5390 0754 7034"]), ("AT611904300234573201 EUR", ["AT611904300234573201"]),
    ("ES9121000418450200051332 PAID", ["ES9121000418450200051332"]), (f"order 12 {CARD}", [CARD]), (f"12/27 {CARD}", [CARD]), ("ref 2024 4111-1111-1111-1111", ["4111-1111-1111-1111"]),
    (f"{PHONE} 12 times", [PHONE]), (f"{IBAN} {SPACED} {CARD}", [IBAN, SPACED, CARD]), (f"AT61 {CARD} x", [CARD]), (f"1234 5678 {CARD} 2024-02-29 9", [CARD, "2024-02-29"]),
    (f"2024-02-29 {CARD} 10.0.0.7 078-05-1120", ["2024-02-29", CARD, "10.0.0.7", "078-05-1120"]), ("4111 1111 1111 1112 10.0.0.7", ["10.0.0.7"]), ("+4111 1111 1111 1111", [CARD]),
    (f"{CARD} 5500 0000 0000 0004 {CARD}", [CARD, "5500 0000 0000 0004", CARD]), (f"a {CARD}abc", []), (f"{CARD} 12abc", [CARD]), (f"No.{CARD}.", [CARD]), ("3782 822463 10005 1", ["3782 822463 10005"]),
    (f"XX00 {IBAN} jo@x.org", [IBAN, "jo@x.org"]), (f"{'7 ' * 3000}{CARD} 1 2", [CARD]), ("\ue000 1.2.2020 \ue000 10.0.0.7", ["1.2.2020", "10.0.0.7"]),
]


def test_values_beside_other_words_and_numbers(spark):
    values = sorted({v for _, vs in BESIDE for v in vs})
    alone = dict(zip(values, pseudonymised(spark, values), strict=True))
    assert all(v != p for v, p in alone.items())
    got = pseudonymised(spark, [t for t, _ in BESIDE])
    for (text, values), new in zip(BESIDE, got, strict=True):
        want, at = "", 0
        for v in values:
            start = text.index(v, at)
            want, at = want + text[at:start] + alone[v], start + len(v)
        if not text.startswith("7 "):
            assert new == want + text[at:], text
        else:  # sevens alone may have a good sum, too
            assert CARD not in new and alone[CARD] in new


def test_no_valid_number_stays_in_clear(spark):
    """Cards as they are printed and account numbers of known countries, found by hand."""
    lengths = {c: n for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()}
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    given, valid = {r.doc_id: r.text or "" for r in docs.collect()}, 0
    for r in pii.pseudonymised(docs, "k").collect():
        text, values = given[r.doc_id], []
        for m in re.finditer(r"(?=(?<!\w)((?:\d{4}[ -]){3}\d{4}|\d{13,19})(?!\w))", text):
            values += [m[1]] * luhn("".join(c for c in m[1] if c.isdigit()))
        for m in re.finditer(r"(?<!\w)([A-Z]{2})\d\d", text):
            part, at = "", m.start()
            while at < len(text) and len(part) < lengths.get(m[1], 0) and (text[at] == " " or text[at].isalnum()):
                part, at = part + text[at].strip(), at + 1
            if len(part) == lengths.get(m[1]) and part.isalnum() and part.isascii() and part.upper() == part and not text[at : at + 1].isalnum() and number(part[4:] + part[:4]) % 97 == 1:
                values.append(text[m.start() : at])
        valid += len(values)
        assert not [v for v in values if v in r.text], r.doc_id
    assert valid > 10


def test_pseudonyms_by_hand(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    extra = ["No.4111 1111 1111 1111 123, 4111-1111-1111-1111 12/27", "GB82WEST12345698765432 a\u0130b@x.org", "+442079460958 or +44 20 7946 0958", "0001-01-01 9999-12-31 9990-01-01 31/12/9999"]
    extra += [t for t in PRIVATE if t] + [t for t, _ in BESIDE]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + n, t) for n, t in enumerate(extra)], "doc_id long, text string"))
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    changed = 0
    for r in pii.pseudonymised(docs, "k").collect():
        want = text_by_hand(given[r.doc_id], "k")
        assert (r.text or "") == want, r.doc_id
        assert r.changed == (want != given[r.doc_id])
        changed += r.changed
    assert changed > len(extra) / 2


def test_one_value_has_one_pseudonym_in_any_layout(spark):
    pairs = [
        ("4111 1111 1111 1111", "4111111111111111"), ("4111-1111-1111-1111", "4111 1111 1111 1111"), ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"),
        ("+44 20 7946 0958", "+442079460958"), ("+1 (017) 555-7713", "+1 017 555 7713"), ("2024-02-29", "29.02.2024"),
    ]
    got = pseudonymised(spark, [x for pair in pairs for x in pair])
    bare = lambda x: re.sub(r"[^0-9A-Z]", "", x)
    for (a, _), x, y in zip(pairs, got[::2], got[1::2]):
        assert x != a and (bare(x) == bare(y) or x.split("-") == y.split(".")[::-1]), (a, x, y)


def test_pseudonyms_of_hard_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x " * 200_000 + "jo.81@mail7.example.com"), (None, "078-05-1120")]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, _found string, _new int")
    got = pii.pseudonymised(df, "k").collect()
    assert sorted((r.doc_id or 0, r.changed) for r in got) == [(0, False), (0, True), (1, False), (1, False), (2, True)]
    assert pii.pseudonymised(df.limit(0), "k").count() == 0


def chain_by_hand(s, edge):
    n = len(s)
    p, total = np.zeros(n), 0.0
    for path in range(1 << n):
        y = [path >> i & 1 for i in range(n)]
        w = np.exp(sum(s[i] for i in range(n) if y[i]) + sum(edge[y[i], y[i + 1]] for i in range(n - 1)))
        total += w
        p += w * np.array(y)
    return p / total


@pytest.mark.parametrize("step", [1, 3, 4, 32])
def test_marginals_by_hand(monkeypatch, step):
    monkeypatch.setattr(toxicity, "STEP", step)
    rng = np.random.default_rng(3)
    sizes, edge = np.array([7, 0, 3, 1, 9, 4, 2, 6]), rng.normal(size=(2, 2))
    s = rng.normal(size=sizes.sum())
    texts = np.split(s, np.cumsum(sizes)[:-1])
    want = np.concatenate([chain_by_hand(x, edge) for x in texts if len(x)])
    assert toxicity.marginals(s, sizes, edge) == pytest.approx(want)
    p, pairs = toxicity.pair_sums(s, toxicity.Chains.of(sizes), edge)
    assert p == pytest.approx(want) and pairs.sum() == pytest.approx(sum(n - 1 for n in sizes if n))
    rest = sum(want_.sum() - want_[0] for want_ in map(lambda x: chain_by_hand(x, edge), [x for x in texts if len(x)]))
    assert pairs[:, 1].sum() == pytest.approx(rest)  # steps to state 1


def test_scores_by_hand(spark):
    """A document's score from its tokens' marginals, these over all paths of the whole text."""
    rows = [(i, f"word{i % 7} you idiot go away" if i % 2 else f"word{i % 7} you friend go away", i % 2) for i in range(200)]
    model = toxicity.fit(rows, {0: 100, 1: 100})
    texts = ["Hello IDIOT there", "you friend", "so what idiot idiot", None, "", "\u0130\u0130\u0130 you idiot"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    for i, t in enumerate(texts):
        s = np.array([model.bias + sum(model.weights.get(f, 0) for f in toxicity.features(x)) for x in re.findall(r"\w+", (t or "").lower())])
        p = chain_by_hand(np.clip(s, -30, 30), model.edge) if len(s) else s
        x = [p.max(), np.log1p(p.sum()), np.sqrt(p.mean())] if len(p) else [0, 0, 0]
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(np.dot(x, model.final[:3]) + model.final[3]))), rel=1e-6)
    assert [(s.start, s.end) for s in got[5].spans] == [(8, 13)] and got[6].score == got[0].score


def test_toxicity_of_a_long_text(spark):
    rows = [(i, f"word{i % 7} you idiot go away" if i % 2 else f"word{i % 7} you friend go away", i % 2) for i in range(200)]
    model = toxicity.fit(rows, {0: 100, 1: 100})
    long = "you friend go " * 40_000
    docs = spark.createDataFrame([(1, long + "idiot"), (1, long), (2, "idiot")], "doc_id long, text string")
    got = toxicity.tag(docs, model).collect()
    assert sorted(len(r.spans) for r in got) == [0, 1, 1]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == queries.table(spark, sf, "documents").count()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.92 * len(held) and sum(p and y for p, y in held) >= 0.5 * sum(y for _, y in held)


def test_toxic_spans(spark):
    rows = [(i, f"word{i % 7} you idiot go away" if i % 2 else f"word{i % 7} you friend go away", i % 2) for i in range(200)]
    model = toxicity.fit(rows, {0: 100, 1: 100})
    docs = spark.createDataFrame([(1, "Hello, IDIOT there", 0.0), (2, None, 0.0), (None, "hello friend", 0.0), (4, "", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(7, 12)] and got[1].score > 0.5
    assert got[2].spans == [] and got[None].score < 0.5 and got[2].score == got[4].score


def test_models_without_labels(spark):
    docs = queries.table(spark, SF, "documents")
    labels = queries.table(spark, SF, "labels").limit(0)
    assert {r.score for r in quality.quality_scores(docs, labels).collect()} == {0.5}
    assert all(r.score < 0.3 for r in toxicity.toxic_scores(docs, labels).collect())
    assert quality.quality_scores(docs.limit(0), labels).count() == 0 and toxicity.toxic_scores(docs.limit(0), labels).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in queries.op10_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_quality_of_hard_rows(spark):
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(HARD)], "doc_id long, text string, score int")
    rows = [(i, "plain words in a line" if i % 2 else "SHOUT!! SHOUT!! SHOUT!!", i % 2) for i in range(60)]
    got = quality.score(docs, quality.fit(rows, {0: 30, 1: 30})).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)


def index_by_hand(word):
    m, c = (1 << 64) - 1, zlib.crc32(word.encode())
    for _ in range(2):
        c = ((c ^ c >> 32) * 0xD6E8FEB86659FD93) & m
    c ^= c >> 32
    out, part = [0.0] * quality.DIM, quality.DIM // quality.ONES
    for k in range(quality.ONES):
        own = c >> 10 * k
        out[k * part + (own & 511) % part] = 1.0 if own >> 9 & 1 else -1.0
    return np.array(out)


def test_quality_by_hand(spark):
    """Vectors and network in plain Python, on repeated, unknown and no words."""
    rows = [(i, "plain words in a line of text" if i % 2 else "SHOUT!! 12 SHOUT!! SHOUT!!", i % 2) for i in range(60)] + [(99, "seen once", 1)]
    model = quality.fit(rows, {0: 30, 1: 31})
    split = [quality.WORD.findall(t) for _, t, _ in rows]
    both = lambda word: index_by_hand(word) + index_by_hand(quality.shape(word))
    near = defaultdict(list)
    for words in split:
        for i, word in enumerate(words):
            around = sum((both(words[k]) for k in range(max(0, i - 2), min(len(words), i + 3)) if k != i), np.zeros(quality.DIM))
            near[word].append(around)
            near[quality.shape(word)].append(around)
            for gap, name in zip((1, 2), quality.AGAIN):
                if i >= gap and words[i - gap] == word:
                    near[name].append(around)
    mean = lambda name: np.mean(near[name], axis=0) / 4 if near[name] else np.zeros(quality.DIM)
    for name, row in model.rows.items():
        assert model.around[row].astype(float) == pytest.approx(mean(name), abs=2e-3)
    assert "seen" not in model.rows and "plain" in model.rows
    texts = ["plain SHOUT!! unknownword seen seen 12", "", None, "words words words", "\u00c9t\u00e9 \u65e5\u672c"]
    around = lambda name: model.around[model.rows[name]].astype(float)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string"), model).collect()}
    m, std, w1, b1, w2, b2 = model.layers
    for i, t in enumerate(texts):
        words = quality.WORD.findall(t or "")
        total = np.zeros(quality.DIM)
        for k, word in enumerate(words):
            total += index_by_hand(word) + index_by_hand(quality.shape(word)) + around(word if word in model.rows else quality.shape(word))
            for gap, name in zip((1, 2), quality.AGAIN):
                if k >= gap and words[k - gap] == word:
                    total += index_by_hand(name) + around(name)
        x = (total / max(1, len(words)) - m) / std
        hidden = [max(0.0, sum(x[a] * w1[a, h] for a in range(len(x))) + b1[h]) for h in range(quality.HIDDEN)]
        z = sum(a * b for a, b in zip(hidden, w2)) + b2[0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z / model.temperature)), rel=1e-4)
    assert got[5] == pytest.approx(got[0], rel=1e-9)


def test_workers_keep_one_thing_at_a_time():
    from cairn.llm import common

    first = common.kept("a", lambda: object())
    common.tidy("a")
    assert common.kept("a", lambda: object()) is first
    common.kept("b", lambda: object())
    assert common.kept("a", lambda: object()) is not first  # another name's tasks came between
    common.tidy()
    assert not common._kept


def test_words_are_remembered_in_two_generations(monkeypatch):
    """Ids don't depend on what an encoder remembers."""
    with open(queries.word_bpe(), encoding="utf-8") as f:
        source = f.read()
    texts = [" ".join(f"word{i % 37} x{i}" for i in range(j, j + 50)) for j in range(0, 2000, 25)]
    want = list(tokens.WordEncoder(source).ids(texts))
    monkeypatch.setattr(tokens, "GROUP", 100)
    encoder = tokens.WordEncoder(source, 30)
    assert list(encoder.ids(texts)) == want
    assert len(encoder.known) < 300 and len(encoder.older) < 300


def test_words_of_letters_go_to_the_model(tokenizer):
    """Texts with letters beyond ASCII share words with others, and only words with other characters pass the tokenizer's preparation."""
    with open(queries.word_bpe(), encoding="utf-8") as f:
        encoder = tokens.WordEncoder(f.read())
    whole, prepared = encoder.tokenizer, []

    class Counted:
        model = whole.model

        def encode_batch_fast(self, words, **more):
            prepared.extend(words)
            return whole.encode_batch_fast(words, **more)

    encoder.tokenizer = Counted()
    latin = [chr(c) for c in range(0xC0, 0x100)]
    texts = ["The Été über STRASSE straße the", "THE été ÜBER 12 don't", *latin, *(f"x{c}Y z{c}, {c}" for c in latin), "".join(latin), "H\u0331 h\u0331"]
    for t, ids in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert not any(w.isalpha() for w in prepared) and "don't" in prepared
    assert b"the" in encoder.known and b"The" not in encoder.known and b"THE" not in encoder.known


def test_tokenizers_with_other_added_tokens_encode_whole_texts():
    import json

    with open(queries.word_bpe(), encoding="utf-8") as f:
        spec = json.load(f)
    assert tokens.splits_at_spaces(spec)
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 49408, "content": "new york"})
    assert not tokens.splits_at_spaces(spec)


def test_distinct_words_are_looked_up_once_and_encoded_together(tokenizer):
    """Of a group of texts each distinct word is looked up once, and its new words of letters go to the model in runs."""
    with open(queries.word_bpe(), encoding="utf-8") as f:
        encoder = tokens.WordEncoder(f.read())
    asked, runs, model = [], [], encoder.prepared

    class Known(dict):
        def get(self, word):
            asked.append(word)
            return super().get(word)

        def __contains__(self, word):
            asked.append(word)
            return super().__contains__(word)

    class Counted:
        def encode_batch_fast(self, texts, **more):
            runs.extend(texts)
            return model.encode_batch_fast(texts, **more)

    encoder.known, encoder.prepared = Known(), Counted()
    texts = ["the cat, the Été. the ÉTÉ! straße: the cat", "", " \n", "été, and the cat" * 50, "Straße"] * 20
    for t, ids in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert len(asked) == len(set(asked)) < 15 and len(runs) == 1


def test_words_are_cut_between_letters_and_marks():
    words, firsts = tokens.words_of(["Été. (Ab,) ×, e\u0301.", "", "\t", "a\u00a0b 7%"])
    want = "Été . (Ab ,) ×, e\u0301. a\u00a0b 7 %".split(" ")
    assert [w.decode() for w in words.to_pylist()] == want and firsts.tolist() == [0, 6, 6, 6, 9]


def test_words_whose_end_no_id_marks_are_encoded_exactly():
    """A tokenizer's file that gives no suffix for ends of words, or takes words of its vocabulary as they are, is followed as well."""
    import json

    from tokenizers import Tokenizer

    with open(queries.word_bpe(), encoding="utf-8") as f:
        spec = json.load(f)
    for model in ({"end_of_word_suffix": None}, {"ignore_merges": True}):
        source = json.dumps({**spec, "model": {**spec["model"], **model}})
        encoder, whole = tokens.WordEncoder(source), Tokenizer.from_str(source)
        assert encoder.wordwise and encoder.ends is None
        for t in ("the cat sat, été.", "inthe an"):
            assert np.frombuffer(next(encoder.ids([t])), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_a_worker_remembers_a_bounded_number_of_words():
    with open(queries.word_bpe(), encoding="utf-8") as f:
        encoder = tokens.WordEncoder(f.read(), 100)
    for j in range(4):
        list(encoder.ids([" ".join(f"a{i}b" for i in range(j * 900, j * 900 + 1000))]))
        assert len(encoder.known) <= 100 and len(encoder.older) <= 100


def test_groups_of_empty_texts_have_no_ids():
    with open(queries.word_bpe(), encoding="utf-8") as f:
        encoder = tokens.WordEncoder(f.read())
    assert list(encoder.ids(["", " \t", ""])) == [b"", b"", b""] and list(encoder.ids([])) == []


def test_packing_encodes_a_table_in_runs_of_words(spark):
    """The encoder that packing's tasks use takes a table's words of letters in few runs, and gives each document's own ids."""
    with open(queries.word_bpe(), encoding="utf-8") as f:
        encoder = tokens.WordEncoder(f.read(), packing.REMEMBERED)
    runs, model = [], encoder.prepared

    class Counted:
        def encode_batch_fast(self, texts, **more):
            runs.extend(texts)
            return model.encode_batch_fast(texts, **more)

    encoder.prepared = Counted()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = dict(zip((d.doc_id for d in docs), encoder.ids(d.text or "" for d in docs), strict=True))
    distinct = {w for run in runs for w in run.split()}
    assert 0 < len(runs) <= len(distinct) // tokens.RUN + 1 and len(encoder.known) >= len(distinct)
    pieces = packing.cut_pieces(spark.createDataFrame(docs), queries.word_bpe(), capacity=100, end_id=1).collect()
    assert {p.doc_id for p in pieces} == set(got)
    for p in pieces:
        part = (got[p.doc_id] + b"\1\0\0\0")[4 * p.start : 4 * (p.start + p.length)]
        assert p.start == 100 * p.piece and len(part) == 4 * p.length and zlib.crc32(part) == p.ids_crc32
