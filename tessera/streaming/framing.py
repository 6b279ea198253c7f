"""Framed messages of an editor session: headers with a length, then that many bytes of JSON."""

from __future__ import annotations

import json
import re

# Bounds of a session's input.
LONGEST_HEADER, LONGEST_BODY = 8 << 10, 64 << 20


class FrameError(ValueError):
    pass


def frames(data: bytes) -> tuple[list[dict], bytes]:
    """(messages, bytes of the one that isn't complete yet). Headers end at an empty line; names are read without regard to case."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if len(data) - at > LONGEST_HEADER:
                raise FrameError("a header is too long")
            return out, data[at:]
        lengths = []
        for line in data[at:end].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if not colon:
                raise FrameError("a header line has no colon")
            if name.strip().lower() == b"content-length":
                lengths.append(value.strip())
        if len(lengths) != 1 or not re.fullmatch(rb"\d{1,10}", lengths[0]):
            raise FrameError("a frame needs one length")
        size = int(lengths[0])
        if size > LONGEST_BODY:
            raise FrameError("a body is too long")
        if len(data) < end + 4 + size:
            return out, data[at:]
        body = data[end + 4 : end + 4 + size]
        try:
            message = json.loads(body.decode("utf-8"))
        except (UnicodeDecodeError, json.JSONDecodeError):
            raise FrameError("a body is no JSON") from None
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0":
            raise FrameError("a message has another protocol")
        out.append(message)
        at = end + 4 + size


def framed(message: dict) -> bytes:
    body = json.dumps(message, ensure_ascii=False, separators=(",", ":")).encode()
    return b"Content-Length: %d\r\n\r\n" % len(body) + body


def utf16_position(text: str, offset: int) -> tuple[int, int]:
    """(line, character) from 0 of a byte offset, characters as UTF-16 units, as editors count them."""
    before = text.encode()[:offset].decode("utf-8", "ignore")
    line = before.count("\n")
    return line, len(before.rpartition("\n")[2].encode("utf-16-le")) // 2


def published(uri: str, version: int, text: str, findings: list[dict]) -> dict:
    """The message that tells an editor a document's findings (start, end, rule_id, severity, message), in order."""

    def at(offset: int) -> dict:
        line, character = utf16_position(text, offset)
        return {"line": line, "character": character}

    ordered = sorted(findings, key=lambda f: (f["start"], f["end"], f["rule_id"]))
    items = [{"range": {"start": at(f["start"]), "end": at(f["end"])}, "severity": 1 if f["severity"] == "error" else 2, "code": f["rule_id"], "source": "tessera", "message": f["message"]} for f in ordered]
    return {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "version": version, "diagnostics": items}}
