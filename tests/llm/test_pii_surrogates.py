"""PII surrogates: found, replaced alike everywhere, distinct, native."""

import re

from pyspark.sql import functions as F

from vecprobe.llm.pii_surrogates import PATTERN, moved_entities, replace_pii

KEY = "k"


def _luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def _run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, n int, kind string")
    rows = replace_pii(df, KEY, **kw).orderBy("doc_id").collect()
    return [r.text for r in rows], rows


def test_formats_are_kept_and_nothing_is_left(spark):
    found = ["a.19@mail5.example.com", "8.196.197.208", "+1 (499) 555-6503", "555-123-4567", "4111 1111 1111 1111", "4111111111111112",
             "1eb9c654e721b4f812088970e66a6345cee33dd6", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "Mr. John Smith", "Frau Anna Müller", "Госпожа Иванова"]
    texts = [f"see {e}, or ({e})." for e in found]
    out, rows = _run(spark, texts, count_as="n_found")
    for e, t, r in zip(found, out, rows, strict=True):
        m = re.fullmatch(r"see (.+), or \((.+)\)\.", t)
        assert r.n_found == 2 and m[1] == m[2] != e
        same = lambda x: re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "w", x))
        if "@" not in e and len(e) < 32:
            assert same(m[1]) == same(e)
        assert len(m[1]) == len(e) or "." in e or re.match(r"\w+\.? ", e)
    assert _luhn(re.sub(r"\D", "", out[4].split(",")[0])) and not _luhn(re.findall(r"\d{16}", out[5])[0])
    assert out[7].upper() == out[7].replace("see", "SEE").replace("or", "OR") and out[2].startswith("see +1 (")
    assert out[8].startswith("see Mr. ") and re.search(r"see Mr\. \w+n \w+ler,", out[8]) and re.search(r"Frau \w+a \w+ler", out[9])
    assert re.search(r"Госпожа [а-яА-Я]+,", out[10])


def test_coreference_and_distinctness_across_documents(spark):
    emails = [f"user{i}@host.example.org" for i in range(300)]
    ips = [f"10.0.{i // 250}.{i % 250}" for i in range(300)]
    texts = [f"{e} {i}" for e, i in zip(emails, ips, strict=True)] + [f"X {e.upper()} y {i}" for e, i in zip(emails, ips, strict=True)]
    out, _ = _run(spark, texts)
    first, again = [t.split() for t in out[:300]], [t.split() for t in out[300:]]
    assert [(a.upper(), b) for a, b in first] == [(x[1], x[3]) for x in again]
    assert len({a for a, _ in first}) == len({b for _, b in first}) == 300
    assert not {b for _, b in first} & set(ips)


def test_colliding_surrogates_move_on(spark, monkeypatch):
    from vecprobe.llm import pii_surrogates as m
    # a tiny space: addresses that differ in one octet of few values
    few = lambda e, s, a: F.concat(F.lit("9.9.9."), F.pmod(F.xxhash64(e, a), F.lit(12)).cast("string"))
    monkeypatch.setattr(m, "_ip", few)
    ips = [f"1.1.1.{i}" for i in range(8)] + ["9.9.9.3"]
    out, _ = _run(spark, ips + [" ".join(ips)])
    assert len(set(out[:9])) == 9 and "9.9.9.3" not in out[:9] and out[9].split() == out[:9]
    df = m.find_entities(spark.createDataFrame([(x,) for x in ips], "text string"))
    assert moved_entities(df, KEY).count() > 0


def test_clean_null_empty_and_long_texts_stay(spark):
    texts = [None, "", "version 3.0 of 2020, 1.2.3.4.5 at 12:30 for 1,000,000 (CC BY-NC 4.0).", "plain words\n\n" * 20_000, "tie", "tie"]
    out, rows = _run(spark, texts)
    assert out == texts and rows[0].asDict().keys() == {"doc_id", "text", "n", "kind"}
    big = "word 8.196.197.208 " * 5000
    assert _run(spark, [big])[0][0].count("8.196.197.208") == 0
    df = spark.createDataFrame([], "doc_id long, text string")
    assert replace_pii(df, KEY).count() == 0
    plan = replace_pii(spark.createDataFrame([(1, "x")], "doc_id long, text string"), KEY)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval")) and PATTERN


def test_a_surname_has_one_surrogate_in_all_mentions(spark):
    names = ["".join("abcdefghijklmnop"[i // 16 ** k % 16] for k in range(3)).capitalize() + "q" for i in range(1500)]
    forms = ["Mr {}", "Mr. {}", "Mrs {}", "Mr John {}", "Anna {}"]
    out, _ = _run(spark, [" / ".join(f.format(n) for f in forms) for n in names])
    last = [{m.split()[-1] for m in t.split(" / ")} for t in out]
    assert all(len(x) == 1 for x in last) and len(set.union(*last)) == 1500 and not set.union(*last) & set(names)
    assert len({t.split(" / ")[3].split()[1] for t in out}) == 1


def test_names_and_short_entities_never_run_out(spark, monkeypatch):
    from vecprobe.llm import pii_surrogates as m
    monkeypatch.setattr(m, "_SYLLABLES", {"latin": ["ba", "do"] * 8, "cyrillic": ["ба", "до"] * 8})
    names = [f"Mr {a}{b}q" for a in "ABCDEFGH" for b in "abcdefgh"]
    emails = [f"{c}@b.example" for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèé"]
    out, _ = _run(spark, [*names, *emails, " and ".join(x.replace("Mr", "Mrs") for x in names)])
    assert len(set(out[:100])) == 100 and all(re.fullmatch(r"[a-z]+@[a-z]\.example", x) for x in out[64:100])
    assert out[100].replace("Mrs", "Mr").split(" and ") == out[:64]


def test_secrets_without_a_run_of_digits_are_found(spark):
    found = ["deadbeef" * 4, "DEADBEEF" * 4, "a1b2c3d4e5f6" * 4, "ab" * 64]
    out, rows = _run(spark, [f"key {e}" for e in found], count_as="n_found")
    for e, t, r in zip(found, out, rows, strict=True):
        assert r.n_found == 1 and e not in t and re.fullmatch("key [0-9a-f]+|key [0-9A-F]+", t) and len(t) == len(e) + 4


def test_spellings_of_one_number_share_its_digits(spark):
    spelled = [["+1 (499) 555-6503", "+14995556503", "+1 499 555 6503"], ["+44 20 7946 0958", "+442079460958"], ["+380 44 123 4567", "+380441234567"],
               ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"], ["499-555-6503", "(499) 555-6503"]]
    out, _ = _run(spark, [e for one in spelled for e in one])
    out, digits = iter(out), []
    for one in spelled:
        new = [next(out) for _ in one]
        assert all(re.sub("[0-9]", "9", x) == re.sub("[0-9]", "9", e) and x != e for x, e in zip(new, one, strict=True))
        digits.append({re.sub("[^0-9+]", "", x) for x in new})
    assert all(len(x) == 1 for x in digits) and len(set.union(*digits)) == len(spelled)
    assert [min(x)[:n] for x, n in zip(digits, (2, 3, 4), strict=False)] == ["+1", "+44", "+380"]


def test_checked_digits_cover_all_spellings(spark):
    # many short numbers in two spellings: attempts are needed
    pairs = [(f"+1 {i // 100:02d} {i % 100:02d}", f"+1{i:04d}") for i in range(0, 10_000, 25)]
    out, _ = _run(spark, [f"{a} or {b}" for a, b in pairs])
    new = [tuple(re.sub("[^0-9+]", "", x) for x in t.split(" or ")) for t in out]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(pairs)
    assert not {a for a, _ in new} & {b for _, b in pairs}
