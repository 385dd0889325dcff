"""Write, audit, publish: a model becomes visible as a whole, and only if its assertions pass.

A store is a folder::

    versions/<version>/<table>   the tables of one load, written under a new name each time
    manifests/<number>.json      one file for each published version, the highest number is current

A load writes a new version beside the published one, has it judged as it reads back from storage,
and commits one manifest by renaming a finished file to the next number.  Until then - a table that
fails to be written, a failed assertion, a lost driver - readers see the version before, whole:
a reader takes all its tables from one manifest.  Two loads at a time conflict on the number; the second one
is told so and may publish on top of the first.

The manifest records the tables with their row counts, the verdicts, and the state of
the inputs and of the library, so a later application can tell that a stored model is
still that of its inputs and open it without a build.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

import tillroll
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources import files

#: Hours after which a version that no manifest names counts as left over by a lost load.
LEFTOVER_HOURS = 48


class LoadRejected(RuntimeError):
    """The audit failed; the version before stays published."""

    def __init__(self, verdicts: list[dict]):
        self.verdicts = verdicts
        failed = [v["assertion"] for v in verdicts if v["result"] != "PASS"]
        super().__init__("not published: " + "; ".join(failed))


@dataclass(frozen=True)
class Manifest:
    number: int
    version: str
    tables: dict[str, dict]  # name: {path, rows, ...}
    verdicts: list[dict] = field(default_factory=list)
    inputs: dict[str, str] = field(default_factory=dict)
    code: str = ""

    @property
    def path(self) -> str:
        """The folder of the version's tables."""
        return next(iter(self.tables.values()))["path"].rsplit("/", 1)[0]


def code_state() -> str:
    """Hash of the library's source (without the corpus operators): a model built by other code is another model."""
    top = pathlib.Path(tillroll.__file__).parent
    sources = [p for p in sorted(top.rglob("*.py")) if "llm" not in p.relative_to(top).parts] if top.is_dir() else []
    digest = hashlib.sha256()
    for p in sources:
        digest.update(str(p.relative_to(top)).encode() + b"\0" + p.read_bytes())
    return digest.hexdigest()[:16] if sources else ""


def home(spark: SparkSession, name: str) -> str:
    """A store's folder that other applications find again: under the configured shared folder, by the hash of its name."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tillroll-models/{hashlib.sha256(name.encode()).hexdigest()[:16]}"


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:08d}.json"

    def published(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in files.children(self.spark, f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, number: int) -> Manifest:
        return Manifest(**json.loads(files.read_text(self.spark, self._manifest(number))))

    def current(self) -> Manifest | None:
        numbers = self.published()
        return self.manifest(numbers[-1]) if numbers else None

    def current_for(self, inputs: dict[str, str]) -> Manifest | None:
        """The published version if it was built by this code from inputs in this state (and is still there)."""
        now = self.current()
        same = now and now.inputs == inputs and now.code == code_state() != ""
        return now if same and files.exists(self.spark, self.folder(now.version)) else None

    def new_version(self) -> str:
        return f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"

    def folder(self, version: str) -> str:
        return f"{self.path}/versions/{version}"

    def commit(self, version: str, tables: dict[str, dict], verdicts: list[dict], inputs: dict[str, str], after: int) -> Manifest:
        """Publish a version as the successor of number ``after``; files.Conflict if that one has a successor."""
        m = Manifest(after + 1, version, tables, verdicts, inputs, code_state())
        files.commit_text(self.spark, self._manifest(m.number), json.dumps(asdict(m), indent=1))
        return m

    def discard(self, version: str) -> None:
        files.delete(self.spark, self.folder(version))

    def retire(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` published versions, and old ones that were never published."""
        numbers = self.published()
        kept = {self.manifest(n).version for n in numbers[-keep:]}
        gone = {self.manifest(n).version: n for n in numbers[:-keep]}
        oldest = (time.time() - LEFTOVER_HOURS * 3600) * 1000
        for version, changed in files.children(self.spark, f"{self.path}/versions").items():
            if version not in kept and (version in gone or changed < oldest):
                self.discard(version)
        for n in gone.values():
            files.delete(self.spark, self._manifest(n))


def write_audit_publish(store: ModelStore, write: Callable[[str, str], dict[str, dict]], read: Callable[[Manifest], object],
                        audit: Callable[[object], DataFrame], rows: Callable[[object], dict[str, int]],
                        inputs: dict[str, str] | None = None, keep: int = 2) -> Manifest:
    """One load.

    ``write(folder, version)`` writes the tables: {name: what a reader has to know beside the path}.  ``read`` opens them,
    ``audit(model)`` gives rows with ``assertion`` and ``result`` - a handful, they reach the driver -, ``rows`` the row counts.
    LoadRejected if a result is not PASS.  Whatever fails, the version is removed and the one before stays.
    """
    numbers = store.published()
    after = numbers[-1] if numbers else 0
    version = store.new_version()
    folder = store.folder(version)
    try:
        layout = write(folder, version)
        tables = {name: {"path": f"{folder}/{name}", **more} for name, more in layout.items()}
        model = read(Manifest(0, version, tables))
        verdicts = [r.asDict() for r in audit(model).collect()]
        if not verdicts or any(v["result"] != "PASS" for v in verdicts):
            raise LoadRejected(verdicts)
        counts = rows(model)
        tables = {name: t | {"rows": counts[name]} for name, t in tables.items()}
        manifest = store.commit(version, tables, verdicts, inputs or {}, after)
    except BaseException:
        store.discard(version)
        raise
    store.retire(keep)
    return manifest
