"""quirelake: document extraction and layout analytics as Spark DataFrame operators."""

import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ship(spark) -> None:
    """Send the package to the session's executors, once, for functions that import more of it there."""
    sc = spark.sparkContext
    if getattr(sc, "_quirelake_shipped", False):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="quirelake-")) / "quirelake.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._quirelake_shipped = True
