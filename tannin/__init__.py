"""Spectral water-chemistry analytics as plain Spark DataFrame functions.

Layers, lowest first:

``functions``  column helpers (missing values, parsing, t distribution)
``sources``    table schemas, readers and writers
``operators``  one DataFrame -> DataFrame step each
``plans``      composed queries: sample metrics, site and date slopes, pairing
``streaming``  the sensor average on an unbounded input
"""

import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors' Python workers, once per application.

    Functions that run there are found by their modules' names.  Where the
    package is installed on every executor, or on the workers' path, this
    changes nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    # Spark's driver serves the file to the executors; the folder is the driver's own
    archive = Path(tempfile.mkdtemp(prefix="tannin-package-")) / "tannin.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as package:
        for module in sorted(here.rglob("*.py")):
            package.write(module, module.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
