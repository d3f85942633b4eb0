import hashlib
import re

import numpy as np
import pytest
from aicensus.llm import secrets
from hypothesis import given, settings
from hypothesis import strategies as st

SCANNER = secrets.Scanner()
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PIECES = ["password", "passwd", "secret", "Token", "api_key", "APIKEY", " ", "  ", ":", "=", "'", '"', "AKIA", "A1B2C3D4E5F6",
          "abcdef0123456789" * 2, "x", "é", "\n", "abcdefgh1", "ſecret", "\0", "ghp_" + "a1" * 20, "🙂", "-", "."]


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=6))
def test_base_spans_as_the_expressions(texts):
    for text, (found, every) in zip(texts, SCANNER.scan(texts)):
        assert found == base(text)
        assert set(found) <= set(every)


def test_strips_give_what_one_pass_gives():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"tokensecret=: \n'abcdef0123456789AKIA", np.uint8), 20_000)
    one = secrets.accepting(SCANNER.dfa, data, lanes=1)
    assert (secrets.accepting(SCANNER.dfa, data, lanes=300) == one).all()


def test_minimised():
    dfa = secrets.compile_rules([secrets.Parser("(ab|cb|(a|c)b)d*", False).parse()], anchored=True)
    assert len(dfa.accept) == 4  # start, one letter, accepting, dead


def test_added_rules_and_reports(docs):
    key = "ghp_" + "Ab1" * 12
    text = f"é {key} and token: secret: abcdefgh1\nxoxb-1234567890 -----BEGIN RSA PRIVATE KEY-----"
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(docs([(1, text), (2, None), (3, ""), (None, "token=12345678")])).collect()}
    kinds = [(m["kind"], text[m["start"]:m["end"]]) for m in rows[1]["matches"]]
    assert kinds == [("github", key), ("assign", "secret: abcdefgh1"), ("chat", "xoxb-1234567890"),
                     ("private_key", "-----BEGIN RSA PRIVATE KEY-----")]
    assert rows[1]["n_assign"] == 0  # hidden for the base rule: "token: secret" comes first
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["spans"] == ""
    assert rows[None]["spans"] == "assign:0:14" and rows[None]["n_assign"] == 1


def test_long_text_and_empty_table(docs):
    text = "0123456789abcdef" * 40_000 + " AKIA" + "Z9" * 10
    row = secrets.scan_secrets(docs([(1, text)])).first()
    assert row["spans"] == f"hex:0:640000,access:640001:{len(text)}"
    assert secrets.scan_secrets(docs([])).count() == 0


OWN = [r"AKIA[A-Z0-9]{16}", r"k.y", r"[^a-z\s]{2,4}", r"(?:ab|c){2}", r"\d+\.\d{1,}", r"[\w-]{3}:", r"x[^\"]*\"", r"\S{3}", r"[]\x41^-]{1,2}", r"k{,2}y",
       r"é{2}", r"[^\W\d]+=", r"a.{0,3}b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("AKIAkyabcx1.é🙂\n\" =:-^]\0Z"), max_size=40), min_size=1, max_size=4))
def test_own_rules_as_the_expressions(texts):
    texts = [*texts, "AKIA" + "A1B2C3D4" * 2, "key k\0y"]
    for text, (found, every) in zip(texts, OWN_SCANNER.scan(texts)):
        assert found == every == sorted((m.start(), i, m.end()) for i, p in enumerate(OWN) for m in re.finditer(p, text, re.A))


OWN_SCANNER = secrets.Scanner(tuple(secrets.Rule(f"r{i}", p, 1, base=True) for i, p in enumerate(OWN)))


def test_unsupported_constructs_are_errors():
    for pattern in (r"^a", "a$", r"\bkey", r"a\B", "a+?", "a{2}?", "a**", "(?i)a", "(?=a)b", r"(a)\1", "a{x}", "a{3,2}", "[a", "(a", "a)", "a\\",
                    r"\pL", r"\xg0", "[é]", "[[:alpha:]]", r"[\w-z]", "[z-a]", "a*", "", "*a", r"\Aa", "{2}", "a{,}"):
        with pytest.raises(ValueError):
            secrets.Scanner((secrets.Rule("own", pattern, 1),))
