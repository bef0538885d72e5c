"""Structure of keys, and texts made to be slow."""

import base64
import textwrap
import time

import pytest

from cueloom.llm import secrets

from .test_operators import _key


def _field(body):
    return len(body).to_bytes(4, "big") + body


PUBLIC = _field(b"ssh-ed25519") + _field(bytes(range(32)))
RSA = _field(b"ssh-rsa") + _field(b"\1\0\1") + _field(bytes(range(1, 200)))


def _container(cipher=b"none", derivation=b"none", options=b"", public=PUBLIC, section=b"\1\2\3\4\1\2\3\4" + bytes(128), keys=1):
    return secrets.OPENSSH + _field(cipher) + _field(derivation) + _field(options) + keys.to_bytes(4, "big") + _field(public) * keys + _field(section)


LOCKED = _container(b"aes256-ctr", b"bcrypt", _field(bytes(16)) + (16).to_bytes(4, "big"), RSA, bytes(range(256)))


@pytest.mark.parametrize("data", [_container(), _container(keys=2), LOCKED, PUBLIC, RSA, _key()])
def test_keys_are_read_to_their_end(data):
    assert secrets.is_key(data) and not secrets.is_key(data + b"\0") and not secrets.is_key(data[:-1])
    b = base64.b64encode(data).decode()
    for text in (b, f"see {b} there", f"x/{b}", '"' + "\\n".join(textwrap.wrap(b, 70)) + '"', "\n".join(textwrap.wrap(b, 70)) + "\n\nWords follow.", "\r\n  ".join(textwrap.wrap(b, 64)) + "."):
        spans = [s for s in secrets.scan_text(text)[-1] if s[0] == "key"]
        assert len(spans) == 1, text[:80]
        _, start, end = spans[0]
        assert "".join(text[start:end].replace("\\n", "").split()).rstrip("=") == b.rstrip("=")
    for text in (b.rstrip("=") + "AAAA", b[: len(b) // 2], b[:60] + "!" + b[60:]):
        assert not [s for s in secrets.scan_text(text)[-1] if s[0] == "key"]


@pytest.mark.parametrize(
    "data",
    [
        secrets.OPENSSH + bytes(18),
        _container(b"none", b"bcrypt"),
        _container(options=b"abc"),
        _container(section=b"\1\2\3\4\1\2\3\5" + bytes(128)),
        _container(section=b"\1\2\3\4\1\2\3\4\0"),
        _container(public=PUBLIC + b"\0"),
        _container(b"aes256-ctr", b"bcrypt", bytes(24)),
        _field(b"ssh-rsa") + _field(b"\1\0\1") + _field(b""),
        _field(b"ssh-foo") + _field(bytes(32)),
    ],
)
def test_what_only_begins_like_a_key_is_none(data):
    assert not secrets.is_key(data)
    assert not [s for s in secrets.scan_text(base64.b64encode(data).decode())[-1] if s[0] == "key"]
    assert not [s for s in secrets.scan_text("b3BlbnNzaC1rZXktdjEA" + "Q" * 24)[-1] if s[0] == "key"]


LARGE = base64.b64encode(bytes([0x30, 0x83, 0x07, 0xFF, 0xFF, 0x02, 0x01, 0x00, 0x30, 0x83, 0x07, 0xFF, 0x00]) + bytes(11)).decode()


@pytest.mark.parametrize("unit", ["/" + "A" * 32, "-MIIEpAIBAAKCAQEA" + "M" * 20, "/" + LARGE, "/MIT/////AgEAMIT///8" + "A" * 24, "-b3BlbnNzaC1rZXktdjEA" + "A" * 14, "/" + base64.b64encode(_container()).decode()[:150], "A" * 64 + "\n", "MIIE" + "\\n" + "M" * 40, "ey.ey.", "token =", "-----BEGIN PRIVATE KEY-----AAAA\n"])
def test_a_million_letters_end_in_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    secrets.scan_text(text)
    assert time.process_time() - began < 5
