"""Forms of assignment that the secrets' lexer reads, against chosen texts and a reader that goes character by character."""

import random
import time

import pytest

from cashlens.llm import secrets

LITERAL = "Zx81kQpW93mmA7"


def found(text):
    return sorted(text[s:e] for s, e, _ in secrets.lexed_spans(text))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r'password = "ab\"cd1234EFghij"', [r"ab\"cd1234EFghij"]),
        ('cfg["db_password"] = "Zx8 kQp W93 mmA7"', ["Zx8 kQp W93 mmA7"]),
        (f'const credential: string = "{LITERAL}"', [LITERAL]),
        (f'credential: Optional[str] = "{LITERAL}"', [LITERAL]),
        (f'credential = """{LITERAL}"""', [LITERAL]),
        (f'signing_key = """\n  {LITERAL}\n  9fKx82mQz71L\n"""\nx = 1', ["9fKx82mQz71L", LITERAL]),
        ('credential = ("Zx81kQpW" "93mmA7aa")', ["93mmA7aa", "Zx81kQpW"]),
        ('credential = (\n  "Zx81k"\n  "QpW93"\n)', ["QpW93", "Zx81k"]),
        (f'signing_key = f"{LITERAL}"', [LITERAL]),
        (f'credential = wrap("{LITERAL}")', [LITERAL]),
        (f'connect(user="bob", credential="{LITERAL}", port=5)', [LITERAL]),
        (f'x = y = "{LITERAL}"\ncredential = x', [LITERAL]),
        (f'"{{\\"credential\\": \\"{LITERAL}\\"}}"', [LITERAL]),
        (f'path = "C:\\dir\\"\ncredential = "{LITERAL}"', [LITERAL]),
        ('passphrase = "hunter2"', ["hunter2"]),
    ],
)
def test_forms(text, want):
    assert found(text) == want
    base, lexed = secrets.all_spans(text)
    assert {(s, e) for s, e, _ in lexed} <= {(s, e) for s, e, _ in secrets.lexed_spans(text)}
    # what is found lies in a base span or comes out as a span of its own
    for s, e, _ in secrets.lexed_spans(text):
        assert (s, e, "lexed") in lexed or any(a <= s and e <= b for a, b, _ in base)


@pytest.mark.parametrize(
    "text",
    [
        'token = os.getenv("GITHUB_TOKEN")', 'token = lookup("github token name")', "credential: string", "passphrase = on",
        f'interface A {{ credential: string; title: string = "{LITERAL}" }}', "it's fine: don't worry, password isn't here",
        f'credential = "unterminated {LITERAL}', "", "=", "(((a=((", 'credential = ""', "credential =", "key: the quick brown fox",
    ],
)
def test_what_is_no_secret(text):
    assert found(text) == []


def plain_string(text, at):
    """Pieces and end of a string without prefix, read character by character."""
    mark = text[at : at + 1]
    if mark not in ("'", '"'):
        return None
    if text[at : at + 3] == mark * 3:
        i = at + 3
        while i < len(text):
            if text[i : i + 3] == mark * 3:
                return (at + 3, i), i + 3
            i += 2 if text[i] == "\\" else 1
    for escapes in (True, False):
        i = at + 1
        while i < len(text) and text[i] != "\n":
            if text[i] == mark:
                return (at + 1, i), i + 1
            i += 2 if escapes and text[i] == "\\" else 1
    return None


def test_strings_against_a_plain_reader():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["'", '"', "a", "b ", "'''", '"""', "\\\\", "\\'", "é"]) for _ in range(rng.randrange(1, 12)))
        want, got = plain_string(text, 0), secrets._Lexer(text).string(0) if text[0] in "'\"" else None
        assert (got is None) == (want is None), text
        if got is not None:
            assert got[1] == want[1] and got[0] == [(*want[0], True)], text


@pytest.mark.parametrize("form", ['name{0} = "Zx81kQpW93mm{0}"\n', 'password = "Zx81kQpW93mm{0}"\n', "a=(", 'f(a="', "x: '", "a = b + ", 'a="""', 'a=f"'])
def test_time_grows_with_the_text(form):
    text = "".join(form.format(i) for i in range(100_000))
    start = time.process_time()
    base, _ = secrets.all_spans(text)
    assert time.process_time() - start < 10 and (len(base) == 100_000 or "password" not in form)


def test_redaction_leaves_nothing_of_a_literal(spark):
    texts = [r'password = "ab\"cd1234EFghij" # a', 'credential = ("Zx81kQpW" "93mmA7aa") # b', f'cfg["db_password"] = """{LITERAL} x"""']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.redacted(rows).collect():
        assert not any(piece in r.text for piece in ("cd1234", "Zx81k", "93mmA7")) and "[SECRET]" in r.text
