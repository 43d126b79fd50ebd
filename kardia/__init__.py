"""kardia — Spark-native personal-health analytics.

Ingests health exports (record / workout / daily-summary XML, ECG CSV
recordings, GPX routes) for many subjects at once, maps them to typed
tables through a declarative manifest, de-duplicates by content hash and
answers the usual questions over them as DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions so Catalyst can prune, push down and code-generate.
"""

from kardia.manifest import Manifest, load_manifest, default_manifest  # noqa: F401
from kardia.session import build_session, scratch_dir  # noqa: F401

__all__ = ["Manifest", "load_manifest", "default_manifest", "build_session", "scratch_dir"]
