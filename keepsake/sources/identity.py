"""Scopes, credentials, resource addresses and configuration."""

from __future__ import annotations

import hmac
import re
import secrets
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from keepsake.functions.hashing import blake3, ulid
from keepsake.functions.scores import Config

RESERVED = ("_admin", "_purged")
FALLBACK = "default"
PREFIX, SECRET_LEAST = "msk", 40
_COMPONENT = re.compile(r"[a-z0-9_-][a-z0-9._-]*")
# Retention profiles as (days of detail rows, cascade of a purge to the audit, days of aggregates); None: no end.
RETENTION = {"balanced": (None, True, None), "gdpr_strict": (90, True, 365), "hipaa_retain": (2190, False, None), "forensic": (None, False, None)}


class Refused(ValueError):
    """An invalid name, address, credential or setting."""


def component(name: str) -> str:
    if len(name.encode()) > 240 or not _COMPONENT.fullmatch(name):
        raise Refused(f"not a scope component: {name!r}")
    return name


def pick_namespace(asked: str | None = None, header: str | None = None, default: str | None = None) -> str:
    """The call's, else the header's, else the credential's, else ``default``; reserved names are refused."""
    chosen = next((c.strip() for c in (asked, header, default) if c and c.strip()), FALLBACK)
    if chosen in RESERVED:
        raise Refused(f"reserved: {chosen}")
    return component(chosen)


def scope_key(tenant: str, subject: str, namespace: str) -> str:
    return "\x1f".join((tenant, subject, namespace))


def parse_resource(uri: str) -> tuple[str, str, str, str]:
    """scheme://tenant/subject/namespace/(audit|stats)"""
    m = re.fullmatch(r"[a-z][a-z0-9+.-]*://([^/]+)/([^/]+)/([^/]+)/(audit|stats)", uri)
    if not m:
        raise Refused(f"not a resource address: {uri!r}")
    return component(m[1]), component(m[2]), component(m[3]), m[4]


@dataclass(frozen=True)
class ApiKey:
    id: str
    tenant: str
    subject: str
    digest: str
    label: str = ""
    default_namespace: str | None = None
    disabled: bool = False


def generate_key(tenant: str, subject: str, label: str = "") -> tuple[str, ApiKey]:
    """(secret, record); only the record's digest is kept."""
    if subject in RESERVED:
        raise Refused(f"reserved: {subject}")
    key_id = ulid()
    secret = f"{PREFIX}_{key_id}_{secrets.token_urlsafe(32)}"
    return secret, ApiKey(key_id, component(tenant), component(subject), blake3(secret.encode()).hex(), label)


def authenticate(presented: str, keys: list[ApiKey]) -> ApiKey:
    """The record of a presented secret; all digests are compared, and a disabled key is refused after it matched."""
    parts = presented.split("_", 2)
    if len(parts) != 3 or parts[0] != PREFIX or len(parts[1]) != 26 or len(parts[2]) < SECRET_LEAST:
        raise Refused("malformed credential")
    digest = blake3(presented.encode()).hex()
    matches = [k for k in keys if hmac.compare_digest(k.digest, digest)]
    if not matches or matches[0].id != parts[1]:
        raise Refused("unknown credential")
    if matches[0].disabled:
        raise Refused("disabled credential")
    return matches[0]


@dataclass
class Settings:
    data_dir: str = "tenants"
    tenant: str | None = None
    subject: str | None = None
    namespace: str | None = None
    embedding_dim: int = 256
    retention: str = "balanced"
    policy: Config = field(default_factory=Config)


def load_settings(path: str) -> Settings:
    """TOML; unknown keys and retention names are refused, and a relative data_dir is beside the file."""
    raw = tomllib.loads(Path(path).read_text())
    known, policy = {f.name for f in fields(Settings)}, raw.pop("policy", {})
    if extra := (set(raw) - known) | (set(policy) - {f.name for f in fields(Config)}):
        raise Refused(f"unknown settings: {sorted(extra)}")
    out = Settings(**raw, policy=Config(**policy).validate())
    if out.retention not in RETENTION:
        raise Refused(f"unknown retention profile: {out.retention}")
    out.data_dir = str(Path(path).parent / out.data_dir)
    return out
