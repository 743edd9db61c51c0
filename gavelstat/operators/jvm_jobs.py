"""Jobs in Java over the partitions of a table, for loops that numpy has no operation for.

The compiler is the one that Spark has in every installation for its own code.  The driver compiles once a session and adds
the classes as a jar, which executors fetch from it.
"""

from __future__ import annotations

import atexit
import pkgutil
import shutil
import tempfile
import zipfile
from functools import lru_cache
from threading import Lock

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SOURCE, PREFIX = "TreeUnits.java", "gavelstat.TreeUnits$"
_ONE_AT_A_TIME = Lock()


@lru_cache(maxsize=1)
def _loader(context):
    """The class loader of the compiled classes, which the session has as a jar."""
    compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(pkgutil.get_data(__package__, SOURCE).decode())
    classes = compiler.getBytecodes()
    folder = tempfile.mkdtemp(prefix="gavelstat-jar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/gavelstat-trees.jar", "w") as jar:
        for name in classes:
            jar.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
    context._jsc.addJar(f"{folder}/gavelstat-trees.jar")
    return compiler.getClassLoader()


def job(spark: SparkSession, name: str, **given: np.ndarray):
    """A job of the class ``name`` with arrays of int32, int64 or double by name."""
    context = spark.sparkContext
    none = [context._gateway.new_array(getattr(context._jvm.java.lang, c), 0) for c in ("Class", "Object")]
    with _ONE_AT_A_TIME:
        loader = _loader(context)
    made = loader.loadClass(PREFIX + name).getDeclaredConstructor(none[0]).newInstance(none[1])
    for key, values in given.items():
        made.put(key, np.ascontiguousarray(values).tobytes())
    return made


def over_partitions(df: DataFrame, made, ddl: str) -> DataFrame:
    """The rows that a job makes of those of each partition, in their order."""
    jvm = df.sparkSession.sparkContext._jvm
    encoder = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(ddl))
    return DataFrame(df._jdf.mapPartitions(made, encoder), df.sparkSession)
