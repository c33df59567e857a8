"""Keys behind a word and letters-only keys are secrets; names, paths and numbers are not."""

import random
import string

import public_tokenizers as P
import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import bpe, secrets  # noqa: E402
from gridloom.llm.common import read_file  # noqa: E402

NAMES = (
    "my-very-long-component-name", "some_module_name_for_testing", "src/main/java/com/example/app", "SOME_LONG_CONSTANT_NAME_2",
    "getElementByIdFromDocument", "getElementByXPathFromHTMLDocument", "Kraftfahrzeughaftpflichtversicherung", "internationalization",
    "build-3f2a9c1-linux-amd64", "release/2024-05-01/notes-v2", "user-550e8400-e29b-41d4-a716-446655440000", "550e8400-e29b-41d4-a716-446655440000",
    "------------------------", "_=_=_=_=_=_=_=_=_=_=_=_=", "12345678901234567890123", "commit/0123456789abcdef0123456789abcdef01234567",
)


@pytest.fixture(scope="module")
def count():
    piece, find = bpe.worker_tools(read_file(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    return lambda run: sum(piece.count(p) for p in find(run))


def keys(prefix, letters, n, size):
    rng = random.Random(f"{prefix} {letters} {n}")
    return [prefix + "".join(rng.choice(letters) for _ in range(n)) for _ in range(size)]


@pytest.mark.parametrize("prefix", ["key-", "sk-", "api_", "my/secret-", "some-quite-long-name-of-a-service-and-its-environment-"])
def test_prefixed_keys(count, prefix):
    for letters, head in ((string.ascii_lowercase + string.digits, prefix), (string.ascii_uppercase + string.digits, prefix.upper())):
        for n in (20, 32):
            runs = keys(head, letters, n, 300)
            assert sum(secrets.method_spans(f"a {k} b", count) == [(2, 2 + len(k), "random")] for k in runs) >= 297


def test_letters_only_keys(count):
    for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase):
        runs = keys("", letters, 32, 300)
        want = [len(k) < secrets.LEAST_RATIO * count(k) for k in runs]
        assert [secrets.looks_random(k, count) for k in runs] == want and sum(want) >= 285


@pytest.mark.parametrize("name", NAMES)
def test_names_are_no_secrets(count, name):
    assert secrets.method_spans(f"a {name} b", count) == []
