"""Hiding secrets of a job's description before it is stored."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from typing import Any

from pyspark.sql import Column, functions as F

KEYS = ("password", "secret")


def masked(config: Any, keys: tuple[str, ...] = KEYS, key: str | None = None) -> Any:
    """The description with the values of secret keys encrypted under ``key``, or starred out without one."""
    if isinstance(config, dict):
        return {k: (encrypt(str(v), key) if key else "*****") if any(x in k.lower() for x in keys) and not isinstance(v, (dict, list)) else masked(v, keys, key) for k, v in config.items()}
    return [masked(x, keys, key) for x in config] if isinstance(config, list) else config


def encrypted(column: Column, password: str) -> Column:
    """A text column under AES (CBC, with an initial vector of its own for each row) as base64, in the JVM; the key is the password's SHA-256."""
    return F.base64(F.aes_encrypt(column, F.unhex(F.sha2(F.lit(password).cast("binary"), 256)), F.lit("CBC"), F.lit("PKCS")))


def decrypted(column: Column, password: str) -> Column:
    """What :func:`encrypted` hid."""
    return F.aes_decrypt(F.unbase64(column), F.unhex(F.sha2(F.lit(password).cast("binary"), 256)), F.lit("CBC"), F.lit("PKCS")).cast("string")


def _stream(key: bytes, nonce: bytes, n: int) -> bytes:
    return b"".join(hmac.new(key, nonce + i.to_bytes(8, "big"), hashlib.sha256).digest() for i in range(-(-n // 32)))[:n]


def _keys(password: str, salt: bytes) -> tuple[bytes, bytes]:
    got = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 65536, 64)
    return got[:32], got[32:]


def encrypt(text: str, password: str) -> str:
    """Authenticated encryption with keys derived by PBKDF2 (HMAC-SHA256 as keystream and tag)."""
    salt, raw = os.urandom(16), text.encode()
    key, mac = _keys(password, salt)
    body = bytes(a ^ b for a, b in zip(raw, _stream(key, salt, len(raw))))
    return base64.b64encode(salt + hmac.new(mac, salt + body, hashlib.sha256).digest() + body).decode()


def decrypt(text: str, password: str) -> str:
    """The text that :func:`encrypt` hid; a wrong password or a changed text raises."""
    raw = base64.b64decode(text)
    salt, tag, body = raw[:16], raw[16:48], raw[48:]
    key, mac = _keys(password, salt)
    if not hmac.compare_digest(tag, hmac.new(mac, salt + body, hashlib.sha256).digest()):
        raise ValueError("wrong password or damaged text")
    return bytes(a ^ b for a, b in zip(body, _stream(key, salt, len(body)))).decode()
