"""Canonical JSON and content ids.

There are several ways to bring numbers into canonical form, and they must stay
apart: the pool truncates floats, the handshake writes a float that is not whole
as a string, the linker writes any number that is not a 64-bit integer as a
string, and the signer refuses floats.
"""

from __future__ import annotations

import json

from .crypto import cid

NUMBERS = ("pool", "handshake", "linker", "strict")


class NotCanonical(ValueError):
    pass


def _string(s: str) -> str:
    out = ['"']
    for c in s:
        if c in '"\\':
            out.append("\\" + c)
        elif c < " ":
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return "".join(out) + '"'


def _number(v, mode: str) -> str:
    small = isinstance(v, int) and -(2**63) <= v < 2**63
    if small:
        return str(v)
    if mode == "strict":
        raise NotCanonical(f"number {v!r}")
    if mode == "linker":
        return _string(json.dumps(v))
    if mode == "handshake":
        return str(int(v)) if float(v).is_integer() and abs(v) < 2**63 else _string(json.dumps(v))
    return str(max(-(2**63), min(2**63 - 1, int(v))))


def jcs(value, numbers: str = "strict") -> str:
    """Canonical text: keys by code point, no spaces, control characters as ``\\u00xx``."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, int | float):
        return _number(value, numbers)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(jcs(x, numbers) for x in value) + "]"
    return "{" + ",".join(f"{_string(k)}:{jcs(value[k], numbers)}" for k in sorted(value)) + "}"


def jcs_cid(value, numbers: str = "strict") -> str:
    return cid(jcs(value, numbers))


def formula_cid(formula) -> str:
    """Key of the pool's formula index."""
    return jcs_cid(formula, "pool")


def formula_hash(formula) -> str:
    """Key of the handshake."""
    return jcs_cid(formula, "handshake")


def implication_hash(antecedent: str, consequent: str) -> str:
    return cid(f"implication:{antecedent}:{consequent}")


def set_cid(cids: list[str], distinct: bool = False) -> str:
    """Id of a set of ids in order; duplicates count unless ``distinct`` rejects them."""
    if distinct and len(set(cids)) != len(cids):
        raise ValueError("duplicate in set")
    return jcs_cid(sorted(cids))


def short(value: str) -> str:
    return value.rpartition(":")[2][:12] + "…"


def contract_cid(contract: dict) -> str:
    keys = ("name", "outBinding", "pre", "post", "inv", "formals", "formalSorts")
    return jcs_cid({k: contract[k] for k in keys if contract.get(k) is not None}, "linker")


def property_hash(contract: dict) -> str:
    """As :func:`contract_cid` without the name: stable under renames."""
    return contract_cid({k: v for k, v in contract.items() if k != "name"})


def kind_of(member: dict) -> str | None:
    header = member.get("header") or (member.get("envelope") or {}).get("header") if isinstance(member.get("envelope"), dict) or "header" in member else None
    if isinstance(header, dict):
        return header.get("kind")
    return (member.get("evidence") or {}).get("kind")


def body_of(member: dict) -> dict | None:
    """The header of a layered member, the evidence body of a flat one."""
    if "envelope" in member or "header" in member:
        return member.get("header") or (member.get("envelope") or {}).get("header")
    return (member.get("evidence") or {}).get("body")


def body_field(member: dict, name: str):
    body = body_of(member) or {}
    if name in body:
        return body[name]
    return (member.get("metadata") or {}).get(name) if "envelope" in member or "header" in member else None


def envelope_cid(member: dict) -> str:
    if isinstance(member.get("envelope"), dict):
        return jcs_cid(member["envelope"], "linker")
    return jcs_cid({k: v for k, v in member.items() if k not in ("cid", "producerSignature")}, "linker")


def member_cid(member: dict) -> str:
    body = body_of(member) or {}
    if kind_of(member) in ("proof-run", "stage-receipt") and body.get("cid"):
        return body["cid"]
    return envelope_cid(member)


def opaque_sort_name(sort: dict) -> str:
    return "S_" + "".join(c for c in jcs_cid(sort).rpartition(":")[2] if c.isalnum())[:32]
