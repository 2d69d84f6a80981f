"""Private keys and long logins: whole spans, values that differ between keys of a type."""

import base64
import random

import pytest
from llm_fixtures import documents

from specsheet.llm import secrets


def key_text(seed: int, size: int = 1190, end: bool = True, fields: str = "", line: str = "\n", kind: str = "RSA ") -> str:
    body = base64.b64encode(random.Random(seed).randbytes(size)).decode()
    lines = [f"-----BEGIN {kind}PRIVATE KEY-----", *([fields] if fields else []), *(body[k : k + 64] for k in range(0, len(body), 64))]
    return line.join(lines + ([f"-----END {kind}PRIVATE KEY-----"] if end else []))


KEYS = [
    key_text(1), key_text(2), key_text(3), key_text(4, line="\\n"), key_text(5, line=" "), key_text(6, end=False), key_text(7, 1191, end=False),
    key_text(8, fields="Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF00FF00FF00FF00FF00FF00FF00FF\n"), key_text(9, line="\r\n"),
    key_text(10, line='\\n" +\n  "'), key_text(11, 48, kind=""), key_text(12, 100_000), key_text(13, end=False, line="\\n"),
]


@pytest.fixture(scope="module")
def found(spark):
    password = "Pq7" * 30
    rows = [(i, f"é before. {k}\nThen the usual text goes on.") for i, k in enumerate(KEYS)]
    rows += [(100 + i, f"copied {key_text(99, line=line)} here") for i, line in enumerate(("\n", "\r\n", "\\n", "\n", " ", "\n"))]
    rows += [(200 + i, "The line -----BEGIN RSA PRIVATE KEY----- starts a key file, so look for it. An END line closes it.") for i in range(8)]
    rows += [(300, f"at https://{'u' * 80}:{password}@host/x now"), (301, "at https://me:secre7pw@host/x")]
    rows += [(302, "a -----BEGIN EC PRIVATE KEY-----\n...\n-----END EC PRIVATE KEY----- b")]
    docs = documents(spark, rows)
    return dict(rows), {r.doc_id: r for r in secrets.secret_report(docs).collect()}, {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}


def test_each_key_is_one_live_span_over_all_its_text(found):
    rows, got, masked = found
    for i, key in enumerate(KEYS):
        assert f"key:10:{10 + len(key)}" in got[i].spans.split(","), i
        assert masked[i] == "é before. [secret]\nThen the usual text goes on.", i


def test_copied_keys_and_bare_headers_stay(found):
    rows, got, masked = found
    for i in [*range(100, 106), *range(200, 208)]:
        assert got[i].spans == "" and masked[i] == rows[i]


def test_key_without_key_text_and_long_login(found):
    _, got, masked = found
    assert got[302].spans.startswith("key:2:")
    assert masked[300] == "at https[secret]host/x now" and masked[301] == "at https[secret]host/x"
