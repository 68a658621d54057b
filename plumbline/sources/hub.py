"""Metadata and listings from a web hub: plain Python on the driver, since pages follow a cursor. The opener is handed in;
tests and closed networks hand in a fake."""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from itertools import islice
from typing import Callable, Iterator
from urllib.parse import quote, urljoin, urlparse

RETRY_CODES = frozenset({429, 500, 502, 503, 504})
ABSENT_CODES = frozenset({401, 403, 404})


class RateLimited(RuntimeError):
    """All tries were used up."""


class TreeListingError(RuntimeError):
    """A listing of files failed, which is not the same as an empty one."""


def _open(request: urllib.request.Request, timeout: float):
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read(), dict(r.headers)


def next_link(header: str | None, base: str) -> str | None:
    """The address marked rel="next"; one on another host than base is refused."""
    for part in re.split(r",\s*(?=<)", header or ""):
        m = re.match(r"\s*<([^>]*)>\s*;(.*)", part)
        if m and re.search(r'(^|;)\s*rel\s*=\s*"?next"?\s*($|;)', m[2]):
            url = urljoin(base, m[1])
            return url if urlparse(url).netloc == urlparse(base).netloc else None
    return None


@dataclass(frozen=True)
class Patience:
    """How long to wait before a call that follows another, and before a retry."""

    tries: int = 5
    between: float = 0.2
    spread: float = 0.4

    def pause(self, failure: Exception, attempt: int) -> float | None:
        """Seconds until the next try; None where another try is of no use. A hub that names a time gets it."""
        if isinstance(failure, urllib.error.HTTPError):
            if failure.code not in RETRY_CODES:
                return None
            asked = str((failure.headers or {}).get("Retry-After") or "")
            if asked.isdigit():
                return float(asked)
        elif not isinstance(failure, (urllib.error.URLError, TimeoutError)):
            return None
        return 2.0**attempt + random.uniform(0, self.spread)


@dataclass
class HubClient:
    base: str
    token: str | None = field(default=None, repr=False)
    opener: Callable = _open
    patience: Patience = Patience()
    timeout: float = 45.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    revision_header: str = "X-Repo-Commit"
    called_at: float = field(default=float("-inf"), repr=False)
    commits: dict = field(default_factory=dict, repr=False)

    def fetch(self, url: str, method: str = "GET") -> tuple[bytes, dict]:
        """The body and the headers in lower case."""
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"} if self.token else {}, method=method)
        for attempt in range(self.patience.tries):
            early = self.called_at + self.patience.between - self.clock()
            if early > 0:
                self.sleep(early)
            self.called_at = self.clock()
            try:
                body, headers = self.opener(request, self.timeout)
            except Exception as failure:
                pause = self.patience.pause(failure, attempt)
                if pause is None:
                    raise
                self.sleep(pause)
            else:
                return body, {k.lower(): v for k, v in headers.items()}
        raise RateLimited(f"gave up after {self.patience.tries} tries")

    def pages(self, url: str | None) -> Iterator[list]:
        """The page at url and all that follow it."""
        while url:
            body, headers = self.fetch(url)
            yield json.loads(body)
            url = next_link(headers.get("link"), url)

    def get_json(self, url: str):
        return json.loads(self.fetch(url)[0])

    def file_url(self, repo: str, path: str) -> str:
        return f"{self.base}/datasets/{repo}/resolve/main/{quote(path)}"

    def get_info(self, repo: str) -> dict | None:
        """The dataset's metadata; None where it is absent, closed or no JSON object."""
        try:
            body, headers = self.fetch(self.file_url(repo, "meta/info.json"))
        except urllib.error.HTTPError as e:
            if e.code in ABSENT_CODES:
                return None
            raise
        if commit := headers.get(self.revision_header.lower()):
            self.commits[repo] = commit
        try:
            got = json.loads(body)
        except ValueError:
            return None
        return got if isinstance(got, dict) else None

    def get_revision(self, repo: str) -> str:
        return self.commits.get(repo, "")

    def exists(self, repo: str, path: str) -> bool:
        try:
            self.fetch(self.file_url(repo, path), "HEAD")
        except urllib.error.HTTPError as e:
            if e.code in ABSENT_CODES:
                return False
            raise
        return True

    def iter_datasets(self, tag: str, page_size: int = 1000, max_pages: int | None = None) -> Iterator[str]:
        for page in islice(self.pages(f"{self.base}/api/datasets?filter={tag}&limit={page_size}"), max_pages):
            yield from (d["id"] for d in page)

    def list_top(self, tag: str, n: int) -> list[str]:
        """The n datasets of a tag that are fetched most often, as the hub sorts them."""
        return [d["id"] for d in self.get_json(f"{self.base}/api/datasets?filter={tag}&sort=downloads&direction=-1&limit={n}")]

    def list_parquet(self, repo: str) -> list[tuple[str, int]]:
        """Path and size of the parquet files below data/ and in its first folder; no other folder is looked into."""

        def listed(folder: str) -> list[dict]:
            return [e for page in self.pages(f"{self.base}/api/datasets/{repo}/tree/main/{quote(folder)}") for e in page]

        try:
            found = listed("data")
            folders = sorted(e["path"] for e in found if e.get("type") == "directory")
            found += listed(folders[0]) if folders else []
        except Exception as e:
            raise TreeListingError(f"no listing of {repo}: {e}") from e
        return sorted((e["path"], e.get("size") or 0) for e in found if e["path"].endswith(".parquet"))


def build_population(client: HubClient, tag: str, most: int | None = None) -> list[str]:
    """Ids of the population, the first `most` of them if given."""
    return list(islice(client.iter_datasets(tag), most))
