import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proseline.llm import op5_pii as op


def brute(text):
    """The contract's patterns, as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and op.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b1", "@", ".", "..", "-", "_", "%", "+", " ", "  ", "1", "25", "256", "10.0.0.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "é", "x@y.z", "\n", "(", ")", "00"]), max_size=25).map("".join))
def test_base_as_the_patterns(text):
    assert op.detect(text) == brute(text)


def found(text, base=False):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in op.find(text) if s["base"] == base]


def test_disguises():
    assert found("write to jane.doe (at) example [dot] com now") == [("email", "jane.doe (at) example [dot] com")]
    assert found("write jane at example dot com now") == [("email", "jane at example dot com")]
    assert found("write jаne@exаmple.com") == [("email", "jаne@exаmple.com")]
    assert found("ip １０.0.0.1 here") == [("ip", "１０.0.0.1")]
    assert found("call +four nine one five one two three four five six now")[0][0] == "phone"
    assert found("card four one one one 1111 1111 1111".replace("1111", "one one one one"))[0] == ("card", "four one one one one one one one one one one one one one one one")
    assert found("x jane＠example．com y") == [("email", "jane＠example．com")]


@pytest.mark.parametrize("gap", ["\u200b", "\u200d", "\u00ad", "\ufeff", "\u2060", "\ufe0f", "\u202c", "\u200b\u200b"])
def test_invisible_characters(gap):
    base = lambda text: [text[a:b] for _, a, b in brute(text)]
    for kind, whole in (("email", "user@example.com"), ("card", "4111111111111111"), ("ip", "192.168.0.11"), ("phone", "+1 (743) 555-3824")):
        for k in range(1, len(whole)):
            hidden = f"{whole[:k]}{gap}{whole[k:]}"
            text = f"see {hidden} there"
            assert found(text) == [(kind, hidden)], (hidden, op.find(text))
            assert [x for _, x in found(text, True)] == base(text)
            assert op.masked(text) == f"see [{kind.upper()}] there"
        for text in (f"see {gap}{whole}{gap} there", f"{gap} {whole}.{gap}"):
            assert found(text) == [] and found(text, True) == [(kind, whole)]
    assert op.find(f"no{gap}thing he{gap}re @{gap} 12{gap}34") == []


def planted(rng):
    """A document with disguised data, and the spans that they have."""
    prose = "the house on a hill was red and we met there before noon in the rain".split()
    name = lambda: "".join(rng.choice(list("bcdfgklmnprst"), 6))
    digits = "zero one two three four five six seven eight nine".split()
    spell = lambda t: " ".join(digits[int(c)] if c.isdigit() else "dot" for c in t)
    kinds = [
        lambda: ("email", f"{name()} at {name()} dot com"), lambda: ("email", f"{name()} (at) {name()} [dot] org"), lambda: ("email", f"{name()}@{name()}.com".replace("c", "\u0441")), lambda: ("email", f"{name()}\u200b@{name()}.net"), lambda: ("email", f"{name()}＠{name()}．com"),
        lambda: ("ip", ".".join(str(rng.integers(10, 250)) for _ in range(4)).replace(".", " dot ")), lambda: ("ip", ".".join(str(rng.integers(10, 250)) for _ in range(4)).replace(".", "[.]")), lambda: ("ip", spell(".".join(str(rng.integers(10, 250)) for _ in range(4)))),
        lambda: ("card", "4111 1111 1111 1111".translate({ord("1"): "１"})), lambda: ("card", spell("4111111111111111")), lambda: ("phone", "+" + spell(str(rng.integers(10**10, 10**11)))), lambda: ("phone", f"+1 743 \u200b555 38{rng.integers(10, 99)}"),
    ]
    text, spans = "", []
    for k in rng.permutation(len(kinds))[:4]:
        text += " ".join(rng.choice(prose, 8)) + ": "
        kind, hidden = kinds[k]()
        spans.append((kind, len(text), len(text) + len(hidden)))
        text += hidden + "; "
    return text + " ".join(prose), spans


def test_recall_of_planted_disguises():
    rng = np.random.default_rng(8)
    caught = wanted = extra = 0
    for _ in range(400):
        text, spans = planted(rng)
        got = {(s["kind"], s["start"], s["end"]) for s in op.find(text)}
        caught += len(got & set(spans))
        wanted += len(spans)
        extra += sum(not any(k == kind and a < z and s < b for kind, a, b in spans) for k, s, z in got)
    assert caught / wanted >= 0.95 and extra / wanted <= 0.05, (caught / wanted, extra / wanted)


def test_clean_prose_stays_clean():
    for t in ("we met at noon and the dot was red", "look at example.com for one two three", "the cat (at home) sat", "point at it", "é è ü ß ñ — “x”", "un deux trois"):
        assert op.find(t) == []


def test_rows(spark):
    texts = [None, "", "a@b.co " * 3, "+1 (743) 555-3824", "x" * 200_000, "1" * 100_000, "@" * 50_000, "227.5.221.1", "a@b.co " * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in op.find_spans(df).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}
    masked = {r.doc_id: r.text for r in op.mask_documents(df).collect()}
    assert masked[2] == "[EMAIL] " * 3 and masked[0] is None and masked[7] == "[IP]"
    assert op.find_spans(df.limit(0)).count() == 0


def test_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.co 1.2.3.4"), (2, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op.op5_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:6,ip:7:14" and got[1].n_email == 1 and got[1].n_card == 0
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


def test_each_mix_of_signs():
    for at in ("@", " at ", " (at) ", "[at]", "  at ", "\nat "):
        for dot in (".", " dot ", " [dot] ", "(dot)", "  dot ", " dot\n"):
            for local in ("jane", f"jane{dot}doe"):
                address = f"{local}{at}example{dot}com"
                assert ("email", address) in found(f"write to {address} now") + found(f"write to {address} now", True), address
    for dot in (" dot ", "[dot]", " (dot) ", "  dot ", "\ndot "):
        assert found(f"from 192{dot}168{dot}0{dot}1 on") == [("ip", f"192{dot}168{dot}0{dot}1")]
    assert found("from 192.168 dot 0.1 on") == [("ip", "192.168 dot 0.1")]
    for t in ("we stayed at home.Then we left", "see it at example.com", "at 10.30 we met at 11.15", "3 dot 5 is less", "available at example.org today"):
        assert op.find(t) == []


def test_short_runs_of_spelled_digits():
    for ip in ("one nine two dot one six eight dot zero dot one", "10.zero.zero.one", "10 [dot] zero [dot] zero [dot] one", "10.0.0.one", "192.168.zero.1", "six.six.six.six"):
        assert found(f"from {ip} on") == [("ip", ip)], ip
    for phone in ("+49 170 123456 seven eight", "+49 170 1234567 eight", "+49 (170) one two 345678", "+49 170 12345 six seven eight"):
        assert ("phone", phone) in found(f"call {phone}, please"), phone
        assert op.masked(f"call {phone}, please") == "call [PHONE], please"
    for card in ("4111 1111 1111 111 one", "4111 1111 one one 11 1111"):
        assert found(f"card {card}.") == [("card", card)]
    assert found("call +49 170 123456 seven eight", True) == [("phone", "+49 170 123456")]
    assert op.masked("write to j\u0430ne@example.com") == "write to [EMAIL]"
    for t in ("in 2019, two or three of one", "chapters one, two and 3", "one. Two. Three. Four", "page 12 one"):
        assert op.find(t) == []


def test_chains_take_linear_time():
    import time

    for text in ("a dot " * 150_000, "a at " * 150_000, "a dot " * 100_000 + "b at c", "one dot " * 50_000):
        began = time.time()
        op.find(text)
        assert time.time() - began < 20
    text = "a dot b at c d " * 2000 + "jane dot doe at example dot com"
    assert found(text) == [("email", "jane dot doe at example dot com")]
    assert found("look at jane at example dot com") == [("email", "jane at example dot com")]
