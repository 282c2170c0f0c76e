"""Repository configuration: what `config init`, `config set` and `config list` read and write."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from .errors import StrataError

FORMAT = 1
#: Backends by scheme of the store's URI.
BACKENDS = ("local", "s3")
IDENTITIES = ("content", "meta")
TRANSFERS = ("auto", "builtin")


@dataclass(frozen=True)
class S3Options:
    bucket: str = ""
    prefix: str = ""
    endpoint_url: str | None = None


@dataclass(frozen=True)
class Config:
    backend: str = "local"
    dataset_root: str | None = None
    default_branch: str = "main"
    identity: str = "content"
    transfer_backend: str = "auto"
    parquet_footer: bool = False
    s3: S3Options = field(default_factory=S3Options)
    format_version: int = FORMAT

    def __post_init__(self) -> None:
        for name, value, allowed in (("backend", self.backend, BACKENDS), ("identity", self.identity, IDENTITIES), ("transfer_backend", self.transfer_backend, TRANSFERS)):
            if value not in allowed:
                raise StrataError(f"{name} must be one of {', '.join(allowed)}, not '{value}'")
        if self.backend == "s3" and not self.s3.bucket:
            raise StrataError("backend s3 needs s3.bucket")
        if not self.default_branch or "/" in self.default_branch:
            raise StrataError(f"invalid branch name '{self.default_branch}'")

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True) + "\n"

    @staticmethod
    def loads(text: str) -> Config:
        try:
            data = json.loads(text)
        except ValueError as e:
            raise StrataError(f"unreadable configuration: {e}") from e
        version = data.get("format_version", 0)
        if version > FORMAT:
            raise StrataError(f"format {version} is newer than this version supports ({FORMAT})")
        if version < FORMAT:
            raise StrataError(f"format {version} is no longer supported")
        unknown = set(data) - set(Config.__dataclass_fields__)
        if unknown:
            raise StrataError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Config(**{**data, "s3": S3Options(**data.get("s3", {}))})

    def with_value(self, key: str, value: str) -> Config:
        """A copy with one setting changed, by its dotted name."""
        if key.startswith("s3."):
            name = key[3:]
            if name not in S3Options.__dataclass_fields__:
                raise StrataError(f"unknown setting '{key}'")
            return replace(self, s3=replace(self.s3, **{name: value or None if name == "endpoint_url" else value}))
        if key not in Config.__dataclass_fields__ or key in ("s3", "format_version"):
            raise StrataError(f"unknown setting '{key}'")
        if key == "parquet_footer":
            if value.lower() not in ("true", "false"):
                raise StrataError("parquet_footer must be true or false")
            return replace(self, parquet_footer=value.lower() == "true")
        return replace(self, **{key: value})

    def items(self) -> list[tuple[str, str]]:
        flat = {k: v for k, v in asdict(self).items() if k != "s3"} | {f"s3.{k}": v for k, v in asdict(self.s3).items()}
        return sorted((k, "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for k, v in flat.items())
