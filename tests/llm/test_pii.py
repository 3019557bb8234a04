import datetime
import random

from cairnframe.llm import pii
from tests.llm.helpers import clashing, documents, saved

C = pii.PiiCipher(b"k")
TEXT = (
    "Mail anna.b+x9@mail.example.org, card 4111 1111 1111 1111 or 4111-1111-1111-1111, IBAN DE89 3704 0044 0532 0130 00, "
    "SSN 123-45-6789, call +1 (988) 555-2485 or 988-555-2485 or +49 30 1234567, host 42.144.35.254, born 1987-02-28, 28.02.1987, 28/02/1987."
)


def test_round_trip_and_validity():
    new, spans = C.replace(TEXT)
    assert sorted({k for *_, k in spans}) == sorted(pii.KINDS)
    assert C.reveal(new) == TEXT
    old = [TEXT[i:j] for i, j, _ in spans]
    assert not any(x in new for x in old)
    _, again = C.replace(new)
    assert [k for *_, k in again] == [k for *_, k in spans]  # every pseudonym is valid in its kind


def test_card_with_digits_behind_it():
    for t in ("4111111111111111 42", "4111 1111 1111 1111 7 8", "4111111111111111 +1 (988) 555-2485"):
        new, spans = C.replace(t)
        assert spans[0][2] == "card" and spans[0][1] in (16, 19) and C.reveal(new) == t


def test_equal_values_stay_linked():
    new, _ = C.replace(TEXT)
    cards = [pii._digits(new[new.index("card ") :][5:24]), pii._digits(new[new.index(" or ") + 4 :][:19])]
    assert cards[0] == cards[1]
    a = C.replace("x +1 (988) 555-2485")[0]
    b = C.replace("y 988.555.2485 z")[0]
    assert pii._digits(a)[1:] == pii._digits(b)
    assert C.replace("1987-02-28")[0].split("-") == C.replace("28.02.1987")[0].split(".")[::-1]
    assert pii.PiiCipher(b"other").replace(TEXT)[0] != new


def test_dates_are_one_calendar():
    rnd = random.Random(4)
    for _ in range(3000):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(rnd.randrange(73_000))
        forms = [d.isoformat(), f"{d.day}/{d.month}/{d.year}", f"{d.day:02d}/{d.month:02d}/{d.year}", f"{d.day}.{d.month:02d}.{d.year}"]
        if d.day > 12:
            forms += [f"{d.month:02d}/{d.day}/{d.year}", f"{d.month}/{d.day}/{d.year}"]
        new = [C.replace(f)[0] for f in forms]
        assert [[len(x) for x in n.replace("-", "/").replace(".", "/").split("/")] for n in new] == [[len(x) for x in f.replace("-", "/").replace(".", "/").split("/")] for f in forms]
        y, m, k = map(int, new[0].split("-"))
        assert {tuple(map(int, n.replace(".", "/").split("/"))) for n in new[1:4]} == {(k, m, y)}
        assert {tuple(map(int, n.split("/"))) for n in new[4:]} <= {(m, k, y)}
        assert [C.reveal(n) for n in new] == forms


def test_many_matches_in_one_text():
    import time

    rnd = random.Random(5)
    text = " ".join((datetime.date(1900, 1, 1) + datetime.timedelta(rnd.randrange(73_000))).isoformat() for _ in range(40_000))
    pii._calendar()
    begin = time.process_time()
    new, spans = pii.PiiCipher(b"z").replace(text)
    assert len(spans) == 40_000 and time.process_time() - begin < 4


def test_digits_of_other_scripts_are_text():
    for t in ("٢٠٢٠-٠٣-٢٥", "１２３-４５-６７８９", "4111 1111 1111 111١", "x²³¹²³¹²³¹²³¹²³¹"):
        assert C.replace(t) == (t, [])


def test_permutation_is_a_bijection():
    for size in (2, 3, 10, 97, 1000, pii._DAYS // 50):
        assert sorted(C.permute(n, size, "t") for n in range(size)) == list(range(size))
        assert all(C.permute(C.permute(n, size, "t"), size, "t", back=True) == n for n in range(0, size, 7))


def test_clean_text_is_left_alone():
    for t in ("", "No numbers here.", "In 1999 we had 12 apples, version 1.2.3, 4111 1111 1111 1112, 999.1.1.1, 31.02.2001, @home", "ratio 3.14159 and 10-20-30", "id 000-12-3456"):
        assert C.replace(t) == (t, [])


def test_table(spark, sf, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    cipher = pii.PiiCipher(pii.DEMO_KEY)
    rows = pii.op4_pii(spark, sf).collect()
    assert {r.doc_id: r.text for r in rows} == {d: cipher.replace(t)[0] for d, t in texts.items()}
    assert sum(r.n_found for r in rows) > 0
    rnd = random.Random(2)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(rnd.randrange(73_000)) for _ in range(200)]
    assert len({C.replace(d.isoformat())[0] for d in days}) == len(set(days))
    odd = pii.op4_pii(spark, saved(clashing(documents(spark)), tmp_path)).collect()
    assert len(odd) == 9 and {r.doc_id: r.text for r in odd}[1] is None
    assert pii.pseudonymise(documents(spark, []), b"k").collect() == []


def test_cards_and_ibans_beside_other_words():
    cards = ("2024-01-15 4111 1111 1111 1111", "Order 12 4111 1111 1111 1111", "12 4111111111111111", "2024-03-07 5555-5555-5555-4444", "7 12 4111 1111 1111 1111 99")
    ibans = ("BE68 5390 0754 7034 USD", "ES91 2100 0418 4502 0005 1332 PAID", "ES9121000418450200051332 EUR", "AB12 BE68 5390 0754 7034")
    for kind, texts in (("card", cards), ("iban", ibans)):
        for t in texts:
            new, spans = C.replace(t)
            assert kind in [k for *_, k in spans], t
            assert C.reveal(new) == t


# a slow matcher, one character after the other, that shares nothing with the operator

WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
DIGIT = "0123456789"


def digits_at(t, i):
    j = i
    while j < len(t) and t[j] in DIGIT:
        j += 1
    return j - i


def behind_is(t, j, chars):
    return j < len(t) and t[j] in chars


def before_is(t, i, chars):
    return i > 0 and t[i - 1] in chars


def slow_ssn(t, i):
    if before_is(t, i, WORD + "-"):
        return None
    s = t[i : i + 11]
    if len(s) < 11 or s[3] != "-" or s[6] != "-" or any(c not in DIGIT for c in s[:3] + s[4:6] + s[7:]) or behind_is(t, i + 11, WORD + "-"):
        return None
    return i + 11 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else None


def slow_ip(t, i):
    if before_is(t, i, WORD + "."):
        return None
    at, parts = i, []
    for k in range(4):
        n = min(3, digits_at(t, at))
        if not n or (k < 3 and not behind_is(t, at + n, ".")):
            return None
        parts.append(t[at : at + n])
        at += n + (k < 3)
    if behind_is(t, at, WORD) or (behind_is(t, at, ".") and behind_is(t, at + 1, DIGIT)):
        return None
    return at if all(str(int(p)) == p and int(p) < 256 for p in parts) else None


def slow_date(t, i):
    if before_is(t, i, WORD + "./-"):
        return None
    found = []
    n = digits_at(t, i)
    for sep, widths in (("-", ((4,), (2,), (2,))), ("/", ((1, 2), (1, 2), (4,))), (".", ((1, 2), (1, 2), (4,)))):
        at, parts = i, []
        for k, allowed in enumerate(widths):
            n = digits_at(t, at)
            n = min(n, max(allowed))
            if n not in allowed or (k < 2 and not behind_is(t, at + n, sep)):
                break
            parts.append(int(t[at : at + n]))
            at += n + (k < 2)
        else:
            if not behind_is(t, at, WORD) and not (behind_is(t, at, "./-") and behind_is(t, at + 1, DIGIT)):
                found.append((at, sep, parts))
    for at, sep, parts in found:
        y, m, d = parts if sep == "-" else parts[::-1]
        if sep == "/" and m > 12 >= d:
            m, d = d, m
        leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
        if 1900 <= y < 2100 and 1 <= m <= 12 and 1 <= d <= (31, 28 + leap, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
            return at
    return None


def slow_email(t, i):
    local = WORD + "._%+-"
    if before_is(t, i, local):
        return None
    j = i
    while behind_is(t, j, local):
        j += 1
    if j == i or not behind_is(t, j, "@") or not any(c in WORD for c in t[i:j]):
        return None
    k = j + 1
    labels, start = [], k
    while behind_is(t, k, WORD + "-."):
        k += 1
    best = None
    # the longest end such that labels before dots are not empty and the last one has two letters or more
    for e in range(k, start, -1):
        labels = t[start:e].split(".")
        if len(labels) > 1 and all(labels[:-1]) and len(labels[-1]) >= 2 and all(c in WORD[:52] for c in labels[-1]):
            best = e
            break
    return best


def test_matches_against_a_slow_matcher():
    rnd = random.Random(11)
    parts = ["12", "4", "2020", "03", "31", "29", "999", "0", "127", "1", "123", "45", "6789", "-", "/", ".", ".", "-", " ", " ", "x", "@", "mail", "org", "a", "_", "+", ",", "é", "２"]
    shapes = ["2020-03-25", "1/2/2020", "31.12.1999", "12/31/2001", "29.02.2019", "123-45-6789", "000-12-3456", "10.0.0.1", "256.1.1.1", "a.b@c.org", "x@y", "q@m-1.co.uk"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) if rnd.random() < 0.75 else rnd.choice(shapes) for _ in range(rnd.randrange(1, 9)))
        kinds = {"email": slow_email, "ssn": slow_ssn, "ip": slow_ip, "date": slow_date}
        taken = []
        for kind in ("email", "ssn", "ip", "date"):
            i = 0
            while i < len(text):
                j = kinds[kind](text, i)
                if j is None:
                    i += 1
                    continue
                if not any(i < e and j > s for s, e, _ in taken):
                    taken.append((i, j, kind))
                i = j
        other = [s for s in C.replace(text)[1] if s[2] not in kinds]
        got = [s for s in C.replace(text)[1] if s[2] in kinds]
        if other:  # telephone, card or account numbers have a place in the order too
            continue
        assert got == sorted(taken), text


def slow_card(t):
    """Card numbers in the usual groups, between characters that belong to no number."""
    found = []
    for i in range(len(t)):
        for shape in ((16,), (4, 4, 4, 4), (4, 6, 5), (15,), (13,)):
            for sep in " -":
                at, ds = i, ""
                for k, n in enumerate(shape):
                    if digits_at(t, at) != n or (k < len(shape) - 1 and not behind_is(t, at + n, sep)):
                        break
                    ds += t[at : at + n]
                    at += n + (k < len(shape) - 1)
                else:
                    total = sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(int(c) for c in reversed(ds)))
                    if total % 10 == 0 and len(set(ds)) > 1 and not before_is(t, i, WORD) and not behind_is(t, at, WORD):
                        found.append((i, at))
    return sorted(set(found))


def test_cards_against_a_slow_matcher():
    rnd = random.Random(12)
    for _ in range(800):
        body = "".join(rnd.choice(DIGIT) for _ in range(rnd.choice([12, 14, 15])))
        number = body + (pii.luhn_check(body) if rnd.random() < 0.6 else rnd.choice(DIGIT))
        shape = {16: [(16,), (4, 4, 4, 4)], 15: [(15,), (4, 6, 5)], 13: [(13,)]}[len(number)]
        groups, at, sep = rnd.choice(shape), 0, rnd.choice(" -")
        out = []
        for n in groups:
            out.append(number[at : at + n])
            at += n
        text = rnd.choice(["", "card ", "(", "no: "]) + sep.join(out) + rnd.choice(["", ".", ")", ", and"])
        assert [(i, j) for i, j, k in C.replace(text)[1] if k == "card"] == slow_card(text), text
