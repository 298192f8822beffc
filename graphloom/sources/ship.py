"""Send the library's modules to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

import graphloom

_sent: set[str] = set()


def ship(spark) -> None:
    """Add the package as a zip to the job's files, once per application.

    Spark serves the file to every executor itself; no shared folder is needed.
    """
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = os.path.dirname(os.path.abspath(graphloom.__file__))
    folder = tempfile.mkdtemp(prefix="graphloom-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "graphloom_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(d, n)
                    z.write(f, os.path.join("graphloom", os.path.relpath(f, top)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
