"""Each operator against a plain version of its contract, and on odd rows: null, empty, repeated, tied, no rows."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import base, components, decontaminate, licenses, linededup, lm, mixing, neardup, pii, quality, tokens, vectors

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __line string, node long"


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def frame(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash", 7) for i, t, s in zip(ids, texts, sources)], SCHEMA).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture()
def scratch(spark):
    return base.Scratch(spark, "test")


VOCABULARY = [a + b for a in "abcdefgh" for b in "aeiou"]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# -- 1 ------------------------------------------------------------------------------------------------------------


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii_keeps_form_and_links(spark):
    texts = [
        "card 4785380592391139.", "again 4785380592391139", "no card 2123465659789240", "+1 (523) 555-1055", "ip 10.1.2.3 and 300.1.1.1", "on 2020-02-29 not 2021-02-29",
        "12/25/1999 25/12/1999 01.05.2001", "ssn 123-45-6789 000-12-1234", "GB82 WEST 1234 5698 7654 32", "hein.19@mail5.example.com", None, "", "plain 12345", "4111 1111 1111 1111",
    ]
    got = by_id(pii.pseudonymise(frame(spark, texts), "k"))
    cards = [re.search(r"\d{16}", got[i]["text"])[0] for i in (0, 1)]
    assert cards[0] == cards[1] != "4785380592391139" and luhn(cards[0]) and got[0]["kinds"] == "card"
    assert got[2]["text"] == texts[2] and got[2]["n_found"] == 0
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", got[3]["text"]) and got[3]["text"] != texts[3]
    assert got[4]["text"].endswith("and 300.1.1.1") and got[4]["n_found"] == 1 and "10.1.2.3" not in got[4]["text"]
    assert got[5]["text"].endswith("not 2021-02-29") and "2020-02-29" not in got[5]["text"]
    assert got[6]["n_found"] == 3 and re.fullmatch(r"\d\d/\d\d/\d{4} \d\d/\d\d/\d{4} \d\d\.\d\d\.\d{4}", got[6]["text"])
    assert got[7]["n_found"] == 1 and got[7]["text"].endswith("000-12-1234")
    iban = got[8]["text"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "GB82WEST12345698765432"
    assert got[9]["text"].endswith("@mail5.example.com") and got[9]["text"] != texts[9]
    assert got[10]["text"] is None and got[11]["text"] == "" and got[12]["text"] == texts[12]
    assert luhn(got[13]["text"].replace(" ", "")) and [len(p) for p in got[13]["text"].split(" ")] == [4, 4, 4, 4]
    assert by_id(pii.pseudonymise(frame(spark, texts), "other"))[0]["text"] != got[0]["text"]
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0


def plain_feistel(l, r, lefts, rights, key, tweak):
    noise = lambda i, x: int(hashlib.sha256(f"{key}:{tweak}:{i}:{x}".encode()).hexdigest()[:14], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            l = (l + noise(i, r)) % lefts
        else:
            r = (r + noise(i, l)) % rights
    return l, r


def plain_digits(d, key, tweak):
    a = len(d) - len(d) // 2
    l, r = plain_feistel(int(d[:a]), int(d[a:] or 0), 10**a, 10 ** (len(d) - a), key, tweak)
    return f"{l:0{a}d}" + (f"{r:0{len(d) - a}d}" if len(d) > a else "")


def plain_refill(form, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def plain_date(text, mark, order, key):
    parts = text.split(mark)
    try:
        day = datetime.date(*[int(parts[order.index(c)]) for c in "ymd"])
    except ValueError:
        return None
    if not datetime.date(1700, 1, 1) <= day <= datetime.date(2099, 12, 31):
        return None
    at = (day - datetime.date(1700, 1, 1)).days
    l, r = plain_feistel(at // 189, at % 189, 773, 189, key, "date")
    new = datetime.date(1700, 1, 1) + datetime.timedelta(l * 189 + r)
    two = "{:02d}" if all(len(p) > 1 for p in parts) else "{}"
    return mark.join(f"{new.year}" if c == "y" else two.format(new.month if c == "m" else new.day) for c in order)


def plain_new(kind, v, key):
    """The pseudonym of a value that has the kind's form; None where the check fails."""
    d = re.sub("[^0-9]", "", v)
    match kind:
        case "card":
            if not luhn(d) or not d.strip("0"):
                return None
            body = d[0] + plain_digits(d[1:-1], key, "card")
            return plain_refill(v, body + next(c for c in "0123456789" if luhn(body + c)))
        case "iban":
            c = v.replace(" ", "")
            if len(c) < 15 or mod97(c) != 1:
                return None
            own = re.sub("[^0-9]", "", c[4:])
            new = plain_refill(c[4:], plain_digits(own, key, "iban")) if len(own) > 1 else c[4:]
            return plain_refill(v, f"{98 - mod97(c[:2] + '00' + new):02d}" + re.sub("[^0-9]", "", new))
        case "phone":
            if d[-10] < "2" or d[-7] < "2":
                return None
            l, r = plain_feistel(*divmod((int(d[-10:-7]) - 200) * 8_000_000 + (int(d[-7:-4]) - 200) * 10_000 + int(d[-4:]), 80_000), 80_000, 80_000, key, "phone")
            m = l * 80_000 + r
            return plain_refill(v, d[:-10] + f"{m // 8_000_000 + 200}{m // 10_000 % 800 + 200}{m % 10_000:04d}")
        case "phone_abroad":
            marked = re.match(r"\+([0-9]{1,3})[ .(-]", v)
            code = marked[1] if marked else v[1:3]
            return plain_refill(v, code + plain_digits(d[len(code) :], key, "abroad"))
        case "ip":
            p = [int(x) for x in v.split(".")]
            if max(p) > 255:
                return None
            l, r = plain_feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65_536, 65_536, key, "ip")
            return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
        case "ssn":
            a, g, s = (int(x) for x in v.split("-"))
            if a in (0, 666) or a > 899 or not g or not s:
                return None
            l, r = plain_feistel((a - 2 if a > 666 else a - 1) * 99 + g - 1, s - 1, 898 * 99, 9_999, key, "ssn")
            at = l // 99
            return f"{at + 2 if at >= 665 else at + 1:03d}-{l % 99 + 1:02d}-{r + 1:04d}"
        case "date_iso":
            return plain_date(v, "-", "ymd", key)
        case "date_dot":
            return plain_date(v, ".", "dmy", key)
        case "date_slash":
            return plain_date(v, "/", "mdy", key)
        case "date_slash_day_first":
            return plain_date(v, "/", "dmy", key)


def plain_pii(text, key):
    """Every form at every start of a text without e-mail addresses, the longest valid one first."""
    out, at, found = "", 0, []
    while at < len(text):
        best = None
        for k in pii.KINDS:
            for form in k.forms:
                m = re.compile(f"(?:{form})(?!{k.after})").match(text, at)
                if not m or re.search(f"(?:{k.before})\\Z", text[:at]):
                    continue
                if (best is None or len(m[0]) > len(best[1])) and (new := plain_new(k.name, m[0], key)) is not None:
                    best = k.name, m[0], new
        out += best[2] if best else text[at]
        at += len(best[1]) if best else 1
        found += [best[0]] if best else []
    return out, found


def test_pii_is_the_plain_permutation_of_every_kind(spark):
    rng = random.Random(13)
    texts = ["card 4111 1111 1111 1111 123", "AB12 4111 1111 1111 1111", "ref.4111111111111111", "+49 4111111111111111", "0.4111111111111111", "x4111111111111111 4111111111111111y"]
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    while len(texts) < 300:
        card = n(rng.choice([13, 15, 16, 19]) - 1)
        card += next(c for c in "0123456789" if luhn(card + c))
        iban = rng.choice(["DE00", "GB00WEST", "FR00"]) + n(rng.choice([14, 16, 18]))
        iban = iban[:2] + f"{98 - mod97(iban):02d}" + iban[4:]
        parts = [card, " ".join(card[i : i + 4] for i in range(0, len(card), 4)), iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4)), f"{n(3)}-{n(2)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"+1 {n(3)} {n(3)} {n(4)}"]
        parts += [f"+{rng.randint(20, 99)} {n(3)} {n(4)}", f"+4930{n(7)}", ".".join(str(rng.randint(0, 280)) for _ in range(4)), f"{rng.randint(1650, 2110)}-{rng.randint(1, 13):02d}-{rng.randint(1, 31):02d}"]
        parts += [f"{rng.randint(1, 31)}.{rng.randint(1, 13)}.{rng.randint(1690, 2100)}", f"{rng.randint(1, 13):02d}/{rng.randint(1, 31):02d}/{rng.randint(1690, 2100)}", f"{rng.randint(13, 31)}/{rng.randint(1, 12):02d}/1999", n(16), n(4), "word", "no 7", "AB12"]
        texts.append(rng.choice(["", "see "]) + rng.choice([" ", " ", ", ", " - ", "\n"]).join(rng.sample(parts, rng.randint(1, 4))) + rng.choice(["", ".", " end"]))
    got = by_id(pii.pseudonymise(frame(spark, texts), "k"))
    seen = set()
    for i, t in enumerate(texts):
        want, found = plain_pii(t, "k")
        seen.update(found)
        assert (got[i]["text"], got[i]["n_found"], got[i]["kinds"]) == (want, len(found), ",".join(sorted(set(found)))), t
    assert seen == {k.name for k in pii.KINDS}
    assert [got[i]["n_found"] for i in range(6)] == [1, 1, 1, 1, 0, 0]


def test_pii_addresses_and_odd_rows(spark):
    mails = by_id(pii.pseudonymise(frame(spark, ["Bob.Smith7@x.org", "bob.smith7@x.org", "a@b", "x" * 300_000 + " 4111111111111111"]), "k"))
    assert mails[0]["text"].lower() == mails[1]["text"] != "bob.smith7@x.org" and mails[0]["text"][0].isupper() and mails[2]["n_found"] == 0
    assert mails[3]["n_found"] == 1 and len(mails[3]["text"]) == 300_017
    local = lambda a: (a[: -(-len(a) // 2)], a[-(-len(a) // 2) :])
    l, r = local("bob.smith7")
    for i in range(1, pii.ROUNDS + 1):
        text, other = (l, r) if i % 2 else (r, l)
        noise = hashlib.sha256(f"k:email:{i}:{other}".encode()).digest()
        turned = "".join(chr((ord(c) - 48 + b) % 10 + 48) if c.isdigit() else chr((ord(c) - 97 + b) % 26 + 97) if c.isalpha() else c for c, b in zip(text, noise))
        l, r = (turned, r) if i % 2 else (l, turned)
    assert mails[1]["text"] == f"{l}{r}@x.org"
    clash = spark.createDataFrame([("4111111111111111", "new", 1, 7, "mine")], "text string, __new string, __found int, n_found int, kinds string")
    got = pii.pseudonymise(clash, "k")
    assert got.columns == ["text", "__new", "__found", "n_found", "kinds"] and got.first()[1:] == ("new", 1, 1, "card")


def test_feistel_is_one_to_one(spark):
    small = spark.range(7 * 11).select(pii.feistel(F.floor(F.col("id") / 11), F.col("id") % 11, 7, 11, "k", "t").alias("p"))
    assert small.distinct().count() == 77
    days = spark.range(0, 146_097, 1, 4).select(F.date_format(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = days.select(pii._new_day(F.col("d").cast("date"), "k").alias("n"))
    assert new.distinct().count() == 146_097 and new.where("n < '1700-01-01' or n > '2099-12-31'").count() == 0


# -- 2 ------------------------------------------------------------------------------------------------------------


def test_licenses_own_nearest_ancestor_and_none(spark, scratch):
    rows = [
        (1, "a/b/x.py", "# Released under the MIT License.\ncode here and more code words"),
        (2, "a/b/c/y.py", "nothing to see"), (3, "a/LICENSE", "Apache License\nVersion 2.0, January 2004\nLicensed under the Apache License, Version 2.0."),
        (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "z.py", None), (6, "a/q.py", ""), (7, None, "text"),
        (8, "driver/d.py", "the driver holds a fishing licence from the council of the town"),
    ]
    docs = spark.createDataFrame([(i, t, p, "x") for i, p, t in rows], "doc_id long, text string, path string, license string")
    got = by_id(licenses.scan_licenses(docs, scratch, F.col("path")))
    assert (got[1]["license"], got[1]["origin"]) == ("MIT", "own")
    assert (got[2]["license"], got[2]["origin"], got[2]["directory"]) == ("GPL-3.0", "inherited", "a/b/c")
    assert (got[6]["license"], got[6]["directory"]) == ("Apache-2.0", "a")
    assert got[3]["license"] == "Apache-2.0" and got[4]["origin"] == "own"
    assert got[5]["license"] is None and got[7]["license"] is None and got[8]["license"] is None
    assert len(got) == len(rows)
    assert licenses.scan_licenses(docs.limit(0), scratch, F.col("path")).count() == 0
    twice = licenses.scan_licenses(docs.unionAll(docs).withColumns({"key": F.lit(1), "term": F.lit(2), "whole": F.lit(3)}), scratch, F.col("path")).collect()
    assert sorted({tuple(r) for r in twice}, key=str) == sorted({tuple(r) for r in got.values()}, key=str)


def test_licenses_wrapped_headers_and_whole_files(spark, scratch):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint main() {}\n"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"
    notice = "# Licensed under the Apache License, Version 2.0 (the\n# \"License\"); you may not use this file except in compliance\n# with the License.  You may obtain a copy of the License at\n#\n#   http://www.apache.org/licenses/LICENSE-2.0\n#\nimport os\n"
    rows = [(1, "m/a.c", mpl, "MPL-2.0"), (2, "g/COPYING", gpl, "GPL-3.0"), (3, "p/LICENSE", apache, "Apache-2.0"), (4, "p/q.py", notice, "Apache-2.0"), (5, "x/y.c", "int x;\n\nint y;", None)]
    lgpl = "/* This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version. */\nint f();\n"
    agpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as\n# published by the Free Software Foundation, either version 3 of the\n# License, or (at your option) any later version.\nimport os\n"
    or_later = "// This program is free software; you can redistribute it and/or modify it\n// under the terms of the GNU General Public License as published by the Free\n// Software Foundation; either version 2 of the License, or (at your option)\n// any later version.\nint g();\n"
    isc = "// Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided that the above\n// copyright notice and this permission notice appear in all copies.\nint h();\n"
    heads = [(6, "l/a.c", lgpl, "LGPL-2.1"), (7, "a/a.py", agpl, "AGPL-3.0"), (8, "o/a.c", or_later, "GPL-2.0"), (9, "i/a.c", isc, "ISC")]
    rows += [(10 + i, f"full{i}/text", t, name) for i, (name, t) in enumerate(licenses.full_texts().items())]
    docs = spark.createDataFrame([(i, t, p) for i, p, t, _ in rows + heads] + [(100 + i, "code", f"full{i}/code.c") for i in range(len(rows) - 5)], "doc_id long, text string, path string")
    got = by_id(licenses.scan_licenses(docs, scratch, F.col("path")))
    assert {i: got[i]["license"] for i, *_ in heads} == {i: name for i, _, _, name in heads}
    assert {i: got[i]["license"] for i, *_ in rows} == {i: name for i, _, _, name in rows}
    # a whole licence is a licence file whatever its name
    assert {i: (got[i + 90]["license"], got[i + 90]["origin"]) for i, *_ in rows[5:]} == {i: (name, "inherited") for i, _, _, name in rows[5:]}


# -- 3 ------------------------------------------------------------------------------------------------------------


def plain_report(text, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} or ({tuple(v)} if v else set())
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_decontamination_is_plain_matching(spark, block_words):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(25)] + [(3, "da fe"), (None, prose(rng, 12)), (40, None), (41, "  ")]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1 or i > 20]
    texts = [None, "", "ééé É"]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 8))
            parts += [" ".join(v[a : a + rng.randint(3, 25)]).upper(), prose(rng, 5)]
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.report(frame(spark, texts + texts[:5]), bench, block_words=block_words))
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == plain_report(t, items), t
    assert decontaminate.report(frame(spark, []), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.report(frame(spark, texts), bench.limit(0)).collect())


def test_clean_cuts_spans_and_keeps_the_rest(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before here, {item.title()}! And after it come more than eleven other words so it stays in.", item, "clean text", None, ""]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, texts)
    got = by_id(decontaminate.clean(docs, bench))
    assert got[0]["text"] == "Before here, ! And after it come more than eleven other words so it stays in."
    assert got[0]["n_chars"] == len(got[0]["text"]) and 1 not in got
    assert got[2]["text"] == "clean text" and got[3]["text"] is None and got[4]["text"] == ""
    assert decontaminate.clean(docs, bench).columns == docs.columns


# -- 4 ------------------------------------------------------------------------------------------------------------


def plain_scores(texts, trained, pull, order):
    toks = [split_words(t) + ["</s>"] for t in texts]
    counts = [Counter() for _ in range(order)]
    starts = sum(trained)
    padded = [["<s>"] * (order - 1) + t for t in toks]
    for t, yes in zip(padded, trained):
        for i in range(order - 1, len(t)):
            for k in range(order):
                if yes:
                    counts[k][tuple(t[i - k : i + 1])] += 1
    n, v, once = sum(counts[0].values()), len(counts[0]), sum(c == 1 for c in counts[0].values())
    unseen = min(max(once, 0.5) / (n + 1), 0.999) if n else 1.0
    out = []
    for t in padded:
        total = base_total = 0.0
        for i in range(order - 1, len(t)):
            c = counts[0][(t[i],)]
            p = (1 - unseen) * c / n if c else unseen
            for k in range(1, order):
                h = tuple(t[i - k : i])
                ch = starts if set(h) == {"<s>"} else counts[k - 1][h]
                p = (counts[k][tuple(t[i - k : i + 1])] + pull[k - 1] * p) / (ch + pull[k - 1])
            total += math.log10(p)
            base_total += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        out.append((len(t) - order + 1, sum(counts[0][(x,)] > 0 for x in t[order - 1 :]), base_total, total))
    return n, out


@pytest.mark.parametrize("order, fan", [(1, 4096), (2, 4096), (3, 4096), (3, 3)])
def test_language_model_is_the_plain_model(spark, scratch, order, fan):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 40)).title() for _ in range(60)] + [None, "", "  \n", "never seen", "x" * 50_000, prose(rng, 1_500)]
    trained = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    n, want = plain_scores(texts, trained, (50.0, 10.0), order)
    got = by_id(lm.language_scores(frame(spark, texts), scratch, base.remainder("doc_id", 5) != 1, order=order, pull=(50.0, 10.0), part_rows=7, part_tokens=200, shard_bytes=2_000, fan=fan))
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w[0], w[1], n)
        assert r["base_score"] == pytest.approx(w[2], abs=1e-9) and r["score"] == pytest.approx(w[3], abs=1e-9)
    assert lm.language_scores(frame(spark, []), scratch, F.lit(True)).count() == 0
    assert lm.language_scores(frame(spark, ["a b"]), scratch, F.lit(False)).first()["n_known"] == 0


def test_language_model_estimates_its_pull(spark, scratch):
    """m is the mean number of words after a context; the parts' files are read in several splits."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(40)]
    grams = [set(), set(), set()]
    for t in texts:
        w = ["<s>", "<s>", *split_words(t), "</s>"]
        for i in range(2, len(w)):
            for k in range(3):
                grams[k].add(tuple(w[i - k : i + 1]))
    want = plain_scores(texts, [True] * 40, (len(grams[1]) / len(grams[0]), len(grams[2]) / len(grams[1])), 3)[1]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = by_id(lm.language_scores(frame(spark, texts).coalesce(1), scratch, F.lit(True), part_rows=3))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[i]["score"] for i in range(40)] == pytest.approx([w[3] for w in want], abs=1e-9)


def test_automaton_has_states_arcs_and_failures():
    """Trained on "a b" twice and "a c": the words are 0 a, 1 b, 2 c, 3 end; the text read is "a c b"."""
    texts = [[0, 1, 3], [0, 1, 3], [0, 2, 3]]
    text = np.array([0, 2, 1, 3])
    count = lambda *g: sum(tuple(t[i : i + len(g)]) == g for t in texts for i in range(len(t)))
    p = lm.Part(np.arange(4, dtype=np.uint64), text, np.array([0, 4]), [np.array([0, 4, 2, 6], np.uint64), np.array([10, 14, 12, 16], np.uint64)])
    counts = [np.array([count(int(w)) for w in text]), np.array([3, count(0, 2), count(2, 1), count(1, 3)])]
    corpus = lm.Corpus(9, 4, 1, 3, (2.0,))
    a = lm.Automaton(p, counts, corpus)
    # the root, the start and the words a, b, c and end in order of their keys: 0, 2 (b), 4 (c), 6 (end)
    assert a.fail.tolist() == [0, 0, 0, 0, 0, 0]
    assert [float(10**x) for x in a.fail_weight] == pytest.approx([1, 2 / 5, 2 / 5, 2 / 4, 2 / 3, 2 / 5])
    root = {w: 0.9 * count(w) / 9 for w in range(4)}
    assert [float(10**x) for x in a.root] == pytest.approx(list(root.values()))
    arcs = {(int(k) // 4, int(k) % 4): (float(10**w), int(t)) for k, w, t in zip(a.key, a.weight, a.target)}
    assert set(arcs) == {(1, 0), (2, 2), (3, 3)}  # start to a, a to c, b to the end; none from c to b
    assert arcs[1, 0] == (pytest.approx((3 + 2 * root[0]) / 5), 2) and arcs[2, 2] == (pytest.approx((1 + 2 * root[2]) / 5), 4) and arcs[3, 3] == (pytest.approx((2 + 2 * root[3]) / 4), 5)
    want = arcs[1, 0][0] * arcs[2, 2][0] * (2 / 3 * root[1]) * arcs[3, 3][0]
    for stretch in (1, 2, 512):
        assert float(10 ** a.traverse(p, stretch)[0]) == pytest.approx(want)


def test_sorted_keys_and_counts_come_back():
    rng = np.random.default_rng(1)
    for keys in ([], [5], [0, 1, (1 << 64) - 1], np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))):
        keys = np.array(keys, np.uint64)
        assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()


# -- 5 ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("few", [50_000, 0])
def test_mixing_meets_targets(spark, scratch, few):
    rng = random.Random(4)
    names = ["big"] * 400 + ["é"] * 60 + ["Z"] * 30 + ["tiny"] * 3 + [None] * 25 + ["empty"] * 4 + ["a"] * 80
    texts = [None if s == "empty" else prose(rng, rng.randint(0, 60)) for s in names]
    docs = frame(spark, texts, sources=names)
    got = by_id(mixing.mix(docs, scratch, few=few))
    sizes = Counter()
    for t, s in zip(texts, names):
        sizes[s] += len(split_words(t))
    want, taken = plain_targets(dict(sizes)), Counter()
    for i, (t, s) in enumerate(zip(texts, names)):
        r = got[i]
        assert r["size"] == len(split_words(t)) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    assert {i: r["taken"] for i, r in by_id(mixing.mix(docs.repartition(5), scratch, bins=3, small=2)).items()} == {i: r["taken"] for i, r in got.items()}
    # unequal odds: of a source that takes part of its documents, short ones are taken more often than long ones
    rate = lambda short: np.mean([got[i]["copies"] for i, s in enumerate(names) if s == "big" and (0 < got[i]["size"] <= 20) == short and got[i]["size"]])
    assert rate(True) > 1.2 * rate(False) > 0
    clash = docs.withColumns({c: F.lit(-7) for c in ("__size", "__of", "__rank", "__copies", "__row")})
    assert sorted(map(tuple, mixing.apply_mix(clash, scratch, few=few).select(*docs.columns).collect()), key=str) == sorted(map(tuple, mixing.apply_mix(docs, scratch, few=few).collect()), key=str)
    assert mixing.apply_mix(clash, scratch, few=few).where("__size = -7 and __of = -7").count() > 0
    out = mixing.apply_mix(docs, scratch, few=few)
    assert out.columns == docs.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    assert all(copies[i] == r["copies"] for i, r in got.items())
    assert mixing.mix(frame(spark, []), scratch).count() == 0


# -- 6 ------------------------------------------------------------------------------------------------------------


def plain_groups(texts, k, percent=80):
    sets = []
    for t in texts:
        w = split_words(t)
        sets.append(set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_the_plain_groups(spark, scratch, k):
    rng = random.Random(9)
    texts = [None, "", " ", "one", "One", "one two", "ONE  two", "one two three"]
    for _ in range(12):
        start = prose(rng, rng.randint(5, 120)).split()
        for _ in range(rng.choice([1, 2, 15])):
            w = list(start)
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += [texts[20]] * 5
    want, sizes = plain_groups(texts, k)
    got = by_id(neardup.near_duplicates(frame(spark, texts), scratch, k=k))
    assert [got[i]["component_id"] for i in range(len(texts))] == want and [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    odd = neardup.near_duplicates(frame(spark, ["a b c", "a b c", "x y z", "x y z"], ids=[None, 4, 4, 9]), scratch, k=k).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in odd if r["doc_id"] is not None) == [(4, 4, True), (4, 4, True), (9, 4, False)]
    assert [(r["component_id"], r["kept"]) for r in odd if r["doc_id"] is None] == [(None, True)]
    assert neardup.near_duplicates(frame(spark, []), scratch).count() == 0


def test_large_buckets_and_clusters_lose_nothing(spark, scratch):
    rng = random.Random(3)
    start = prose(rng, 80).split()
    texts = []
    for _ in range(60):
        w = list(start)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts.append(" ".join(w))
    other = start[:60] + prose(rng, 20).split()  # a second group in the same candidate cluster
    texts += [" ".join(other[:i] + [rng.choice(VOCABULARY)] + other[i + 1 :]) for i in range(0, 80, 3)]
    docs, want = frame(spark, texts), plain_groups(texts, 2)[0]
    reps = neardup.sketches(docs, 2).select(F.col("doc_id").alias("node"), "bands", "sig").dropDuplicates(["node"])
    least = neardup.least_slots(0.8)
    groups = []
    for most in (20_000, 5):
        clusters = components.components(neardup.candidate_edges(scratch.keep(reps), scratch, least, most), scratch)
        linked = by_id(components.components(neardup.confirmed_edges(docs, clusters, scratch, 2, 80, block_bytes=3_000), scratch), "node")
        groups.append([linked[i]["component"] if i in linked else i for i in range(len(texts))])
    assert groups == [want, want]
    one = scratch.keep(frame(spark, texts).select(F.lit(1).cast("long").alias("g"), F.col("doc_id").alias("node"), F.col("text").alias("body")))
    for first, at_once in ((1, 2), (90, 1_000)):
        linked = by_id(components.components(neardup.linked_in_groups(one, neardup._same_text(2, 80), scratch, 1 << 30, 10, first, at_once), scratch), "node")
        assert [linked[i]["component"] if i in linked else i for i in range(len(texts))] == want
    assert len(set(want)) > 2


def test_spanning_forest_has_the_components():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(2, 40)
        link = np.zeros((n, n), bool)
        for _ in range(rng.randint(0, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            link[a, b] = link[b, a] = True
        edges = neardup.spanning(n, lambda i: link[i])
        full, got = neardup.Forest(n), neardup.Forest(n)
        for a, b in zip(*np.nonzero(link)):
            full.join(int(a), int(b))
        for a, b in edges:
            assert got.join(a, b)
        assert [full.root(i) for i in range(n)] == [got.root(i) for i in range(n)]


def test_components_of_chains_and_hubs(spark, scratch):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 3), (3, 9)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(500, 560), 500), 9: 3, 3: 3}


def test_bitmap_lets_all_ids_through(spark, scratch):
    ids = scratch.keep(spark.range(0, 3_000, 3).select(F.col("id").alias("x")))
    rows = spark.range(3_000).select("id", F.lit(b"z").alias("__bits"), F.lit(1).alias("__of"), F.lit(2).alias("__at")).unionAll(spark.sql("select cast(null as bigint), binary('z'), 1, 2"))
    got = base.maybe_in(rows, "id", ids, "x", most_buckets=2).collect()
    assert all(r["__maybe"] for r in got if r["id"] is not None and r["id"] % 3 == 0) and sum(r["__maybe"] for r in got) < 1_200
    assert {(bytes(r["__bits"]), r["__of"], r["__at"]) for r in got} == {(b"z", 1, 2)} and len(got) == 3_001


def test_bit_similarity_is_near_the_real_one():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = both[:3000], both[600:3600]  # 2400 of 3600
    m = neardup.minima(np.concatenate([a, b]), np.array([0, 3000, 6000]))
    s = neardup.signature(m)
    assert abs(neardup.similarity(neardup.equal_slots(s[0], s[1])) - 2400 / 3600) < 0.15


# -- 7 ------------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(6)
    good = [prose(rng, rng.randint(10, 80)).capitalize() + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randint(10, 80)).split()) for _ in range(80)]
    texts = good + bad + [None, "", "x"]
    docs = frame(spark, texts + [good[0]], ids=[*range(len(texts)), 0])
    labelled = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 230, 2)] + [(1, 5), (None, 1), (999, 0)], "doc_id long, label int")
    got = quality.quality_scores(docs, labelled).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r["score"] <= 1 for r in got)
    right = [r["predicted"] == int(r["doc_id"] < 150) for r in got if r["doc_id"] < 230 and r["doc_id"] % 2]
    assert sum(right) / len(right) > 0.95
    clash = docs.withColumns({"__score": F.lit(-7), "Score": F.lit("s")})
    kept = quality.keep_good(clash, labelled)
    assert kept.columns == clash.columns and {(r["__score"], r["Score"]) for r in kept.collect()} == {(-7, "s")}
    kept = quality.keep_good(docs, labelled)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}
    assert {r["score"] for r in quality.quality_scores(docs, labelled.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(frame(spark, []), labelled).count() == 0


def plain_features(text):
    """Classes of letters by runs, whether a word repeats the one before, n-grams of that up to three, and words."""
    shapes, found, last = [], set(), None
    for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()):
        if not w:
            continue
        kind = re.sub(rb"[\x80-\xff]", b"a", re.sub(rb"[a-z]", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", w))))
        low = w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
        shapes.append((re.sub(rb"(.)\1+", rb"\1", kind, flags=re.S), low == last))
        last = low
        found.add(("word", low))
    for n in (1, 2, 3):
        found.update(tuple(shapes[i : i + n]) for i in range(len(shapes) - n + 1))
    return found


def test_quality_features_are_the_plain_ones():
    """Equal plain features have equal numbers, and there are as many numbers as features but for hash collisions."""
    rng = random.Random(14)
    words = ["Hello", "hello", "WORLD", "it's", "42", "!!", "x1y2", "été", "a", "A.", "Foo-Bar"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n", " \t end"]) for _ in range(200)] + ["", " "]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, ptr = quality.features(np.frombuffer(data, np.uint8), offsets)
    number, plain = {}, [plain_features(t) for t in texts]
    for t, want in enumerate(plain):
        assert abs(ptr[t + 1] - ptr[t] - len(want)) <= 1, texts[t]
        own = set(ids[ptr[t] : ptr[t + 1]].tolist())
        for f in want:
            number[f] = number.get(f, own) & own
    assert all(number.values())  # each feature has a number that is in all of its texts
    assert len(plain[-1]) == 0 == ptr[-1] - ptr[-2]


def test_quality_hinge_and_platt_are_at_their_optimum():
    rng = np.random.default_rng(15)
    y = np.where(rng.random(60) < 0.6, 1.0, -1.0)
    rows = [np.unique(np.where(rng.random(12) < (0.7 if up > 0 else 0.3), rng.integers(0, 20, 12), rng.integers(15, 40, 12))) for up in y]
    ratio, cost = rng.standard_normal(40) + 0.1, np.where(y > 0, 0.7, 1.3)
    weight, bias = quality._hinge(rows, y, ratio, cost, 3_000, 1)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        v = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, r], x[i, 40] = v, 1.0
    whole = np.append(weight, bias)
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    # projected gradient on the dual gives a plain lower bound
    q, a = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(60)
    for _ in range(20_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.eigvalsh(q)[-1] if _ == 0 else a - (q @ a - 1) * step, 0, cost)
        step = 1 / np.linalg.eigvalsh(q)[-1] if _ == 0 else step
    dual = a.sum() - 0.5 * a @ q @ a
    assert dual - 1e-6 <= primal(whole) <= dual + 0.02 * abs(dual)
    margin = rng.standard_normal(200)
    side = np.where(rng.random(200) < 1 / (1 + np.exp(-(2 * margin + 0.5))), 1.0, -1.0)
    slope, shift = quality._platt(margin, side)
    up, down = (side > 0).sum(), (side <= 0).sum()
    t = np.where(side > 0, (up + 1) / (up + 2), 1 / (down + 2))
    loss = lambda a, b: -(t * np.log(1 / (1 + np.exp(-(a * margin + b)))) + (1 - t) * np.log(1 - 1 / (1 + np.exp(-(a * margin + b))))).sum()
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-5 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


# -- 8 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_comes_back(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    assert (tokens.unpack(tokens.pack(ids, bits), bits, len(ids)) == ids).all()


def test_token_files_hold_what_the_tokenizer_gives(spark, scratch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(8)
    pieces = ["don't", "THE&&&", "été…,", "áb", "<|endoftext|>", "<|ENDOFTEXT|>", "中1", "\x1c", "\x85", "\xa0", "≠", "İ", "x's.", "12,5", "\n", "long" * 40]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", prose(rng, 3_000)]
    ids = [5 * i for i in range(len(texts))]
    manifest = tokens.write_tokens(frame(spark, texts, ids=ids), scratch, path, shard_bytes=2_000)
    got, start = by_id(tokens.read_tokens(manifest)), 0
    for i, t in zip(ids, texts):
        want = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(want)), t
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert manifest.count() > 1
    file = manifest.orderBy("shard").first()["path"].removeprefix("file://")
    with open(file, "rb") as f:
        t = tokens.TokenFile(f)
        assert t.document(0).tolist() == plain.encode(texts[0] or "", add_special_tokens=False).ids + [2]
        assert t.ids(0, t.n_ids)[3:9].tolist() == t.ids(3, 9).tolist()
    twice = tokens.read_tokens(tokens.write_tokens(frame(spark, ["b", "a", "a", None], ids=[1, 1, None, 1]), scratch, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in twice] == [None, 1, 1, 1] and [r["start"] for r in twice][0] == 0
    assert tokens.read_tokens(tokens.write_tokens(frame(spark, []), scratch, path)).count() == 0


def test_other_tokenizers_take_the_plain_path(spark, scratch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Two  words", " a\nb ", None, "", "don't é 中 <|endoftext|>"]
    got = by_id(tokens.read_tokens(tokens.write_tokens(frame(spark, texts), scratch, path, end_id=5)))
    for i, t in enumerate(texts):
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(plain.encode(t or "", add_special_tokens=False).ids + [5], "<u4").tobytes())
    assert tokens.load(public_tokenizers.path("word_bpe_49k.json"))[1] and not tokens.load(path)[1]
    assert tokens.vocabulary_size(public_tokenizers.path("word_bpe_49k.json"), 2) == 49_408


# -- 9 ------------------------------------------------------------------------------------------------------------


def plain_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup_is_plain(spark, scratch):
    rng = random.Random(11)
    shared = [prose(rng, 14) for _ in range(6)] + ["Éa " * 20, "short line", "x" * 40, "x" * 39]
    docs = [(i, "\n".join(rng.choice([rng.choice(shared), rng.choice(shared).upper(), "\t" + rng.choice(shared) + " ", prose(rng, 12), ""]) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, shared[0]), (None, shared[0] + "\nrest")]
    df = frame(spark, [t for _, t in docs], ids=[i for i, _ in docs])
    got = by_id(linededup.drop_repeated_lines(df, scratch, batches=5, fanout=2))
    want = plain_lines(docs)
    assert {i: (r["n_lines"], r["n_dropped"], r["kept"]) for i, r in got.items()} == want
    assert hashlib.sha256(got[81]["kept"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert linededup.drop_repeated_lines(frame(spark, []), scratch).count() == 0


def test_first_seen_lines_by_batch(spark, scratch):
    a, b, c = ("a" * 45, "b" * 45, "c" * 45)
    batches = [frame(spark, [f"{a}\n{b}"], ids=[1]), frame(spark, [f"{b}\n{c}"], ids=[2]), frame(spark, [f"{a}\n{c}"], ids=[3])]
    assert [x.count() for x in linededup.first_seen(batches, scratch, fanout=2)] == [2, 1, 0]


def test_runs_are_joined_without_exchange_or_sort(spark, scratch):
    store = linededup.LineRuns(scratch)
    for ids in ([9, 8], [7, 6]):
        lines = linededup.long_lines(frame(spark, ["a" * 45 + "\n" + "b" * (40 + i) for i in ids], ids=ids), 40)
        store.admit(lines.select("doc_id", "h1", "h2").distinct())
    with linededup._sorted_buckets(spark):
        plan = store.fresh(store.tallies[-1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and " Sort " not in plan
    assert sorted(r["keeper"] for r in store.repeated(4).collect()) == [9]


def test_long_documents_of_repeated_lines(spark, scratch):
    lines = [f"{i:050d}" for i in range(100_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i in range(5)], "doc_id long, text string")
    got = by_id(linededup.drop_repeated_lines(docs, scratch))
    assert [(got[i]["n_lines"], got[i]["n_dropped"]) for i in range(5)] == [(100_000, 100_000)] * 4 + [(100_000, 0)]


# -- 10 -----------------------------------------------------------------------------------------------------------


def test_near_vectors_are_the_plain_links(spark, scratch):
    rng = np.random.default_rng(12)
    rows, n = [], 0
    for label in (0, 1, None):
        for size in (1, 1, 2, 5, 60, 1):
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((n, [float(x) for x in centre + rng.standard_normal(16) * 0.08], label))
                n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [], 0), (n + 5, rows[0][1], 0), (n + 6, rows[0][1][:5], 0), (n + 7, [1e300 * x for x in rows[0][1]], 0), (None, rows[0][1], 0), rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, scratch, k=4, tables=4).collect()}
    real = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            real[i] = (label, len(v), np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()))
    links = {i: {j for j in real if i != j and real[i][:2] == real[j][:2] and real[i][2] @ real[j][2] >= 0.98} for i in real}
    for i, _, _ in rows:
        if i is None:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, None, True)
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(seen), min(seen) == i)
    assert vectors.near_vectors(df.limit(0), scratch).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = {tuple(sorted(map(tuple, vectors.near_vectors(twice.repartition(n), scratch).collect()))) for n in (1, 3, 4)}
    assert got == {((1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False))}


def plain_vector_groups(rows, threshold=0.98):
    m = np.array([v for _, v, _ in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    lowest = np.arange(len(m))
    while True:
        new = np.minimum(lowest, np.where(near, lowest[None, :], len(m)).min(1))
        if (new == lowest).all():
            return {r[0]: (int(near[i].sum()), rows[lowest[i]][0]) for i, r in enumerate(rows)}
        lowest = new


@pytest.mark.parametrize("noise", [0.0, 1e-5])
def test_near_vectors_join_groups_with_full_lists(spark, scratch, noise):
    """60 copies of x and 60 of y with a cosine of 0.985, equal or nearly so; no id is divisible by 20."""
    rng = np.random.default_rng(3)
    x, y = np.eye(16)[0], np.eye(16)[0] * 0.985 + np.eye(16)[1] * (1 - 0.985**2) ** 0.5
    rows = [(20 * i + 1 + (i % 2), [float(a) for a in (x if i % 2 else y) + rng.standard_normal(16) * noise], 0) for i in range(120)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain_vector_groups(rows)
    assert {(r["n_links"], r["component_id"]) for r in got} == {(119, 1)}


def test_near_vectors_small_groups_beside_a_large_one(spark, scratch):
    """A graph that hardly starts and descends one round misses pairs, which a large group's links must not hide."""
    rng = np.random.default_rng(4)
    centres = [rng.standard_normal(16) for _ in range(151)]
    members = [centres[0]] * 400 + [c for c in centres[1:] for _ in range(2)]
    rows = [(i, [float(a) for a in c + rng.standard_normal(16) * 0.02], 0) for i, c in enumerate(members)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for more in ({}, {"fewest": 1, "least_recall": 1.0}):
        got = vectors.near_vectors(df, scratch, k=4, tables=1, reach=1, most_rounds=1, attempts=1, every=7, **more).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain_vector_groups(rows)


def test_near_vectors_lose_no_link_where_few_are_audited(spark, scratch):
    """As in a table too large to audit all of: a poor graph whose misses no audit would count."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((300, 16))
    rows = [(3 * i + 1, [float(a) for a in centres[i % 300] + rng.standard_normal(16) * 0.05], 0) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df, scratch, k=2, tables=1, reach=1, most_rounds=1, attempts=1, every=10**9, fewest=1, least_recall=0.0).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain_vector_groups(rows)


def test_links_across_components_are_all_found(spark, scratch):
    """Lone vectors, tight groups and one chain that winds round more than a right angle, in several parts and tiles."""
    rng = np.random.default_rng(6)
    turn = np.deg2rad(np.arange(0, 200, 5))
    chain = np.concatenate([np.stack([np.cos(turn), np.sin(turn)], 1), np.zeros((len(turn), 6))], 1)
    centres = rng.standard_normal((30, 8))
    m = np.concatenate([chain, chain + rng.standard_normal(chain.shape) * 0.03, np.repeat(centres, 5, 0) + rng.standard_normal((150, 8)) * 0.1, centres[:9] + rng.standard_normal((9, 8)) * 0.2, rng.standard_normal((200, 8))])
    m /= np.linalg.norm(m, axis=1)[:, None]
    node = list(range(len(m)))
    of = {i: 0 for i in range(len(turn))} | {80 + i: 80 + i // 5 * 5 for i in range(150)}
    group = np.array([of.get(i, i) for i in node])
    space = np.where(np.array(node) % 7 == 6, 2, 1)
    for c in set(of.values()):
        space[group == c] = 1
    rows = [(i, int(space[i]), [float(x) for x in m[i]]) for i in node]
    df = spark.createDataFrame(rows, "id long, space long, v array<double>")
    clusters = spark.createDataFrame(list(of.items()), "node long, component long")
    x, y = np.nonzero((m @ m.T >= 0.98) & (group[:, None] != group[None, :]) & (space[:, None] == space[None, :]))
    want = {(min(a, b), max(a, b)) for a, b in zip(group[x].tolist(), group[y].tolist())}
    pairs = lambda found: {(min(a, b), max(a, b)) for a, b in ((int(group[r["a"]]), int(group[r["b"]])) for r in found.collect())}
    assert len(want) > 50 and pairs(vectors.across(df, clusters, 0.98, scratch)) == want
    placed = df.join(clusters, df["id"] == clusters["node"], "left").selectExpr("id", "space", "v", "coalesce(component, id) as component", "0.0D as reach")
    assert pairs(vectors.joining(placed, 0.98, scratch, at_once=100, block=37)) == want
