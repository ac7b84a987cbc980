"""Containers byte by byte: a writer of chunks, and a reader from the first byte to the last."""

import struct
import xml.etree.ElementTree as ET

from sonarframe.sources.xdf import BOUNDARY, FORMATS, MAGIC, header


def chunk(tag, content):
    body = struct.pack("<H", tag) + content
    return bytes([4]) + struct.pack("<I", len(body)) + body


def head(stream, name, kind, fmt, channels, rate):
    return chunk(2, struct.pack("<I", stream) + header(name, kind, channels, rate, fmt).encode())


def samples(stream, fmt, rows):
    """A chunk of (stamp or None, values)."""
    body = b""
    for t, values in rows:
        body += b"\0" if t is None else b"\x08" + struct.pack("<d", t)
        body += b"".join(bytes([4]) + struct.pack("<I", len(v.encode())) + v.encode() for v in values) if fmt == "string" else struct.pack(f"<{len(values)}{FORMATS[fmt]}", *values)
    return chunk(3, struct.pack("<I", stream) + bytes([4]) + struct.pack("<I", len(rows)) + body)


def number(data, at):
    size = data[at]
    if size not in (1, 4, 8):
        raise ValueError
    return int.from_bytes(data[at + 1 : at + 1 + size], "little"), at + 1 + size


def one_chunk(data, fmt, channels):
    n, at = number(data, 0)
    out = []
    for _ in range(n):
        stamp = None
        flag, at = data[at], at + 1
        if flag:
            (stamp,), at = struct.unpack_from("<d", data, at), at + 8
        values = []
        for _ in range(channels):
            if fmt == "string":
                m, at = number(data, at)
                if at + m > len(data):
                    raise ValueError
                values.append(data[at : at + m].decode())
                at += m
            else:
                values.append(float(struct.unpack_from("<" + FORMATS[fmt], data, at)[0]))
                at += struct.calcsize("<" + FORMATS[fmt])
        out.append((stamp, values))
    return out


def parse(data):
    """(stream, kind, idx, stamp, offset, x, texts) of all rows but for XML."""
    if data[:4] != MAGIC:
        raise ValueError("this is not an XDF file")
    out, known, at = [], {}, 4
    while at < len(data):
        try:
            length, begin = number(data, at)
            tag = int.from_bytes(data[begin : begin + 2], "little")
            if length < 2 or begin + length > len(data) or not 1 <= tag <= 6:
                raise ValueError
        except (ValueError, IndexError):
            found = data.find(BOUNDARY, at + 1)
            if found < 0:
                break
            at = found + 16
            continue
        body, at = data[begin + 2 : begin + length], begin + length
        if tag not in (2, 3, 4, 6):
            continue
        stream, body = int.from_bytes(body[:4], "little"), body[4:]
        if tag == 2:
            info = ET.fromstring(body.decode())
            rate = float(info.findtext("nominal_srate"))
            known[stream] = [info.findtext("channel_format"), int(info.findtext("channel_count")), 1 / rate if rate else 0.0, 0, 0.0, 0]
            out.append((stream, "header", None, None, None, None, None))
        elif tag == 6:
            out.append((stream, "footer", None, None, None, None, None))
        elif tag == 4:
            out.append((stream, "clock", None, *struct.unpack("<dd", body), None, None))
        elif stream in known and (known[stream][0] == "string" or known[stream][0] in FORMATS):
            state = known[stream]
            try:
                found = one_chunk(body, state[0], state[1])
            except (ValueError, IndexError, struct.error):
                continue
            for stamp, values in found:
                state[4:] = [state[4], state[5] + 1] if stamp is None else [stamp, 0]
                x, texts = (None, values) if state[0] == "string" else (values, None)
                out.append((stream, "sample", state[3], state[4] + state[5] * state[2], None, x, texts))
                state[3] += 1
    return out
