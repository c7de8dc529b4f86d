"""Object stores by environment: where data lies and how Spark reaches it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Store:
    """An S3-compatible store. Without an endpoint it is the cluster's own default."""

    bucket: str
    endpoint: str | None = None

    def path(self, *parts: str) -> str:
        return "/".join((f"s3a://{self.bucket}", *(p.strip("/") for p in parts)))

    def settings(self) -> dict[str, str]:
        """Settings of a session, for this bucket alone; keys come from the cluster's credential providers, never from here."""
        if self.endpoint is None:
            return {}
        of = f"spark.hadoop.fs.s3a.bucket.{self.bucket}"
        return {f"{of}.endpoint": self.endpoint, f"{of}.path.style.access": "true", f"{of}.connection.ssl.enabled": str(self.endpoint.startswith("https:")).lower()}


def store(environ: Mapping[str, str] = os.environ) -> Store:
    """``TERRASHIFT_ENV`` is dev (the default: a store on this machine) or prod, where ``TERRASHIFT_ENDPOINT`` must be
    given; ``TERRASHIFT_BUCKET`` names the bucket, and the endpoint can be given for dev too. Anything else is an error,
    so that no job writes to a store that nobody named."""
    name = environ.get("TERRASHIFT_ENV", "dev")
    if name not in ("dev", "prod"):
        raise ValueError(f"TERRASHIFT_ENV is {name!r}: dev or prod")
    endpoint = environ.get("TERRASHIFT_ENDPOINT") or (None if name == "prod" else "http://localhost:4566")
    if endpoint is None:
        raise ValueError("TERRASHIFT_ENDPOINT is not set: prod has no default")
    return Store(environ.get("TERRASHIFT_BUCKET") or f"{name}-data", endpoint)
