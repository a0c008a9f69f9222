import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "assign": r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
TEST = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
    "card": lambda m: 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and spans.luhn(d),
    "phone": lambda m: 10 <= len(re.sub(r"\D", "", m[0])) <= 15,
    "assign": lambda m: len(m[1]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "hex": lambda m: len(m[0]) >= 32,
}


def plain(text, kinds):
    found = [(k, *m.span()) for k in kinds for m in re.finditer(PATTERNS[k], text) if TEST[k](m)]
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


parts = st.lists(st.sampled_from(["a", "B.", "@", "@x", ".co", "-", " ", "+", "1", "42", ".", "(5)", "4111 1111 1111 1111", "256", "0.0.0.0", "+1 (202) 555-0100", "password", "TOKEN", "api_key", "apikey", "=", ":", "'", '"', "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "0f", "é", "ſecret=abcdefgh", "x_y/z+w="]), max_size=25).map("".join)


@given(parts)
@settings(max_examples=1500, deadline=None)
def test_as_the_plain_patterns(text):
    assert spans.pii(text) == plain(text, spans.PII_KINDS)
    assert spans.secrets(text) == plain(text, spans.SECRET_KINDS)


def test_long_runs_take_linear_time():
    t = time.process_time()
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "token " * 50_000, "password" + " " * 300_000, "f" * 300_000, "AKIA" * 70_000):
        spans.pii(text), spans.secrets(text)
    assert time.process_time() - t < 10


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=8), st.integers(0, 45), st.integers(1, 9))
@settings(max_examples=500, deadline=None)
def test_cover(some, start, size):
    found = [("x", a, a + n) for a, n in some]
    assert spans.Cover(found).meets(start, start + size) == any(a < start + size and start < b for _, a, b in found)


def test_replaced():
    assert spans.replaced("abcdef", [("X", 1, 3), ("Y", 2, 4), ("Z", 5, 6)]) == "aXeZ"
    assert spans.replaced("abc", []) == "abc"
