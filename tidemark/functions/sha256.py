"""SHA-256 that can stop after any byte and go on elsewhere.

hashlib keeps its state to itself, so the state is taken from the OpenSSL library that hashlib is built on. Where
that has no such functions there is no state, and a digest has to be made in one go.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import hashlib

# SHA256_CTX: eight words, two of length, sixteen of data, two of bookkeeping
_CONTEXT = 112


def _library():
    try:
        import _hashlib

        return ctypes.CDLL(_hashlib.__file__)
    except (ImportError, AttributeError, OSError):
        return ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so")


class Resumable:
    """Like hashlib.sha256, with a state that another process can go on from."""

    def __init__(self, state: bytes | None = None):
        self._lib = _library()
        self._at = ctypes.create_string_buffer(state or b"", _CONTEXT)
        if not state:
            self._lib.SHA256_Init(self._at)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._at, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._at.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._at.raw, _CONTEXT)
        self._lib.SHA256_Final(out, last)
        return out.raw.hex()


@functools.cache
def resumes() -> bool:
    """Whether this Python can stop and go on; tried on two lengths."""
    try:
        first = Resumable()
        first.update(b"a" * 1000)
        second = Resumable(first.state())
        second.update(b"b" * 77)
        return first.hexdigest() == hashlib.sha256(b"a" * 1000).hexdigest() and second.hexdigest() == hashlib.sha256(b"a" * 1000 + b"b" * 77).hexdigest()
    except (AttributeError, OSError):
        return False
