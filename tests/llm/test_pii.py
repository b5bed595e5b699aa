import re

import pytest

from sondeflow.llm import pii
from sondeflow.llm.pii import detect, find_pii, redact, redacted, spans


def plain(text):
    """The contract's expressions as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_as_the_plain_expressions():
    import random

    r = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "25", "255", "256", " ", "(", ")", "4532015112830366", "10.0.0.1", "é", "x@y.zz", "+1 ", "555", "\n", "_", "%"]
    for _ in range(4000):
        text = "".join(r.choices(parts, k=r.randint(1, 25)))
        assert detect(text) == plain(text), text


@pytest.mark.parametrize(
    "text,kind,hidden",
    [
        ("write to jane.doe (at) mail (dot) example (dot) com today", "email", "jane.doe (at) mail (dot) example (dot) com"),
        ("write to jane at mail dot example dot com today", "email", "jane at mail dot example dot com"),
        ("x jаne@exаmple.com y", "email", "jаne@exаmple.com"),
        ("at １０.０.０.１ now", "ip", "１０.０.０.１"),
        ("call plus one four one five five five five two six seven one now", "phone", None),
        ("pay 4532​0151​1283​0366 ok", "card", "4532​0151​1283​0366"),
        ("please e-mail jane.doe at mail.example.com today", "email", "jane.doe at mail.example.com"),
        ("mine is jane_d @ example . com, thanks", "email", "jane_d @ example . com"),
        ("call plus one four one five double five five two six seven one now", "phone", None),
        ("pay 45320I51 1283O366 ok", "card", "45320I51 1283O366"),
        ("from l92.168.O.12 it came", "ip", "l92.168.O.12"),
        ("pay four five three two zero one five one one two eight three zero three six six ok", "card", "four five three two zero one five one one two eight three zero three six six"),
    ],
)
def test_disguises_map_back(text, kind, hidden):
    base, added = spans(text)
    assert not [b for b in base if b[0] == kind]
    found = [text[a:b] for k, a, b in added if k == kind]
    assert found and (hidden is None or found == [hidden])


@pytest.mark.parametrize("text", ["meet me at noon, one or two of us", "look at example.com", "we wrote it at home. Then we left @ noon. Fine", "the 10l bottle and 1O of them", "the dot at the end", "naïve café üöß", "1.2.3"])
def test_clean_texts_stay_clean(text):
    assert spans(text) == ([], [])


def disguised(seed, n=600):
    """Texts with what is hidden in each: kind and span, none for a clean one."""
    import random

    r = random.Random(seed)
    plain = "the a of river stone walks under bright morning paper at dot one three point window light table nine".split()
    names, hosts = ["jane.doe", "max_b", "k.lee7", "info"], [("mail", "example", "com"), ("firm", "org"), ("uni", "test", "de")]
    digit = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
    look = {"a": "а", "e": "е", "o": "о", "0": "０", "1": "１", "4": "４", "5": "５", ".": "．"}

    def card():
        while True:
            d = "4" + "".join(r.choices("0123456789", k=15))
            if pii.luhn(d):
                return d

    def phone():
        return "1" + "".join(r.choices("23456789", k=10))

    def make():
        kind = r.choice(["email", "ip", "card", "phone"])
        if kind == "email":
            name, host = r.choice(names), r.choice(hosts)
            way = r.randrange(4)
            if way == 0:
                return kind, f"{name} (at) {' [dot] '.join(host)}"
            if way == 1:
                return kind, f"{name} at {' dot '.join(host)}"
            if way == 2:
                return kind, "".join(look.get(c, c) if r.random() < 0.5 else c for c in f"{name}@") + ".".join("".join(look.get(c, c) if k == 0 else c for k, c in enumerate(h)) for h in host)
            return kind, f"{name} @ {'.'.join(host)}"
        if kind == "ip":
            text = ".".join(str(r.randint(10, 250)) for _ in range(4))
            return kind, "".join(look.get(c, c) for c in text) if r.random() < 0.5 else text.replace(".", "․")
        if kind == "card":
            d = card()
            return kind, " ".join(digit[c] for c in d) if r.random() < 0.5 else "​".join(d[k : k + 4] for k in range(0, 16, 4))
        d = phone()
        return kind, "plus " + " ".join(digit[c] for c in d) if r.random() < 0.5 else "＋" + d

    out = []
    for k in range(n):
        before, after = (" ".join(r.choices(plain, k=r.randint(3, 20))) + " stone" for _ in range(2))
        if k % 2:
            out.append((f"{before} {after}", None))
        else:
            kind, hidden = make()
            out.append((f"{before}, {hidden}, {after}", (kind, len(before) + 2, len(before) + 2 + len(hidden))))
    return out


def test_precision_and_recall_of_added_spans():
    hit = wanted = said = 0
    for text, hidden in disguised(11):
        base, added = spans(text)
        if hidden in base:  # chance left it undisguised
            continue
        wanted += hidden is not None
        said += len(added)
        hit += hidden in added
    assert wanted > 290 and hit / wanted >= 0.95 and hit / said >= 0.95, (hit, wanted, said)


def test_long_runs_are_linear():
    for c in ("a", "1", "@", " ", "1 ", "one ", "а", "(", "+1"):
        spans(c * 60_000)


def test_table(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a@b.cc", 0), (4, "a@b.cc", 0), (4, "a@b.cc", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = find_pii(df).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 3
    assert {r.spans for r in got if r.n_email} == {"email:0:6"}
    assert {r.text for r in redact(df).collect()} == {None, "", "<EMAIL>"}
    assert find_pii(df.limit(0)).count() == 0


def test_redaction_joins_overlaps():
    assert redacted("ab cd ef", [("ip", 0, 4), ("card", 3, 5)]) == "<IP> ef"


def test_long_text_keeps_edits_only():
    """A disguise in a long text is mapped back exactly, with memory for the text and not for a number a character."""
    import tracemalloc

    head = "plain words, ünd more. " * 100_000
    text = head + "write to jane (at) host (dot) org " + head
    tracemalloc.start()
    base, added = pii.spans(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert base == [] and [(k, text[a:b]) for k, a, b in added] == [("email", "jane (at) host (dot) org")]
    assert peak < 12 * len(text)
