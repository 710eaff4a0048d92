"""Small file-system steps through the cluster's own file-system layer."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path object) of a path in any storage Spark can reach."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Rename over an existing file: readers see the old or the new content."""
    system, old = file_system(spark, source)
    _, new = file_system(spark, target)
    system.mkdirs(new.getParent())
    jvm, options_class = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(options_class, 1)
    options[0] = options_class.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(system.makeQualified(old), system.makeQualified(new), options)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    system, target = file_system(spark, path)
    system.mkdirs(target.getParent())
    stream = system.create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def join_files(spark: SparkSession, parts: list[str], target: str) -> None:
    """One file with the bytes of several, copied by the file-system layer."""
    system, path = file_system(spark, target)
    system.mkdirs(path.getParent())
    out = system.create(path, True)
    try:
        for part in parts:
            source = system.open(file_system(spark, part)[1])
            try:
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
    finally:
        out.close()
