"""Objects under a root of any file system that Spark reads: local, or a bucket by its scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_missing(error: Exception) -> bool:
    """Whether a file system's error says that an object isn't there, as stores put it."""
    return any(x in str(error) for x in ("FileNotFoundException", "NoSuchKey", "NotFound", "Status Code: 404"))


class Objects:
    """put, get, exists, delete_prefix, upload, count_prefix and listings of keys under root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self.recursive = not (root.startswith(("/", "file:")))  # buckets know no folders

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def put(self, key: str, data: bytes) -> None:
        out = self._fs.create(self._path(key), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes | None:
        """None for what is missing or a folder."""
        path = self._path(key)
        if not self.exists(key):
            return None
        try:
            size = self._fs.getFileStatus(path).getLen()
            stream = self._fs.open(path)
        except Exception as e:  # removed meanwhile
            if is_missing(e):
                return None
            raise
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        path = self._path(key)
        return self._fs.exists(path) and self._fs.getFileStatus(path).isFile()

    def delete_prefix(self, prefix: str) -> None:
        self._fs.delete(self._path(prefix.rstrip("/")), True)

    def upload(self, key: str, local: str) -> None:
        self._fs.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(local), self._path(key))

    def count_prefix(self, prefix: str) -> int:
        """Files right under a folder; in buckets, at any depth."""
        path = self._path(prefix.rstrip("/"))
        if not self._fs.exists(path) or self._fs.getFileStatus(path).isFile():
            return 0
        files, n = self._fs.listFiles(path, self.recursive), 0
        while files.hasNext():
            files.next()
            n += 1
        return n

    def frame(self, prefix: str = "", content: bool = False) -> DataFrame:
        """key, size, modified (and content) of all objects, at any depth."""
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{prefix}".rstrip("/"))
        key = F.substring_index("path", f"{self.root.split(':', 1)[-1].lstrip('/')}/", -1)
        return df.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def storage(spark: SparkSession, bucket: str = "", folder: str = "") -> Objects:
    """The bucket if one is set, else the folder."""
    return Objects(spark, f"s3a://{bucket}" if bucket else folder)


def upload_key(user: str, job: str) -> str:
    return f"uploads/{user}/{job}.pdf"


def output_key(user: str, job: str) -> str:
    """The suffix is the same for every language."""
    return f"outputs/{user}/{job}_vi.pdf"


def glossary_key(user: str) -> str:
    return f"glossary/{user}/glossary.csv"
