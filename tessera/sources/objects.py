"""Objects in a shared folder: whole objects, byte ranges, listings, and scans of many at once.

Single requests go through Hadoop's file system, so any store that Spark reads will do; scans are Spark jobs over the
binaryFile source, which skips names that begin with _ or .: objects of such names are first copied under others.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import bucket
from tessera.session import file_system, scratch

#: The end of an object's name while it is written.
PART = ".part"
UNFINISHED = re.compile(r"(^|/)\.[0-9a-f]{32}\.part$")
STATUS = "length long, is_directory boolean, replication int, block_size long, modification_time long, uri string"


def _skipped(name: str) -> bool:
    """Whether Spark's file sources leave a file or folder out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


@dataclass
class ObjectStore:
    spark: SparkSession
    base: str

    def _at(self, key: str = "") -> tuple:
        fs, path = file_system(self.spark, f"{self.base.rstrip('/')}/{key}" if key else self.base)
        return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), path  # without checksum files beside

    def put(self, key: str, data: bytes, overwrite: bool = True) -> None:
        """Writes beside, under a name of its own, and renames: readers see the old or the new object whole.

        Without ``overwrite`` an object that exists is an error, and of several writers at once just one succeeds, as far as
        the store's rename is atomic (as on local disks and HDFS).
        """
        fs, path = self._at(key)
        jvm = self.spark._jvm
        fs.mkdirs(path.getParent())
        beside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}{PART}")
        out = fs.create(beside, False)
        out.write(bytearray(data))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                self._move_local(fs, beside, path, overwrite)
            elif overwrite:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, path, options)
            elif fs.exists(path) or not fs.rename(beside, path):
                raise FileExistsError(key)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise FileExistsError(key) from e
            raise OSError(f"Failed to store object: {key}") from e
        finally:
            fs.delete(beside, False)

    def _move_local(self, fs: JavaObject, beside: JavaObject, path: JavaObject, overwrite: bool) -> None:
        """A rename that replaces, or a link that fails if the name is taken; both are atomic."""
        nio = self.spark._jvm.java.nio.file
        source, target = (nio.Paths.get(fs.pathToFile(p).getAbsoluteFile().toURI()) for p in (beside, path))
        if not overwrite:
            nio.Files.createLink(target, source)
            return
        options = self.spark.sparkContext._gateway.new_array(nio.CopyOption, 2)
        options[0], options[1] = nio.StandardCopyOption.ATOMIC_MOVE, nio.StandardCopyOption.REPLACE_EXISTING
        nio.Files.move(source, target, options)

    def size(self, key: str) -> int:
        fs, path = self._at(key)
        try:
            return fs.getFileStatus(path).getLen()
        except Py4JJavaError as e:
            raise FileNotFoundError(f"Failed to retrieve object: {key}") from e

    def get(self, key: str) -> bytes:
        size = self.size(key)
        return self.get_range(key, 0, size - 1) if size else b""

    def get_range(self, key: str, start: int, end: int = -1) -> bytes:
        """Bytes start to end, both inclusive; -1: to the end. Other bounds outside the object are an error."""
        size = self.size(key)
        last = size - 1 if end == -1 else end
        if start < 0 or start >= size or last < start or last >= size:
            raise ValueError(f"range {start}..{end} outside an object of {size} bytes")
        if last - start + 1 > (1 << 31) - 1:
            raise ValueError("a range of over 2 GB")
        fs, path = self._at(key)
        stream = fs.open(path)
        stream.seek(start)
        data = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, last - start + 1)
        stream.close()
        return bytes(data)

    def delete(self, key: str) -> None:
        """Idempotent."""
        fs, path = self._at(key)
        fs.delete(path, False)

    def list(self, prefix: str = "") -> list[str]:
        """Keys that begin with the prefix as a string, at any depth; not the prefix itself."""
        fs, base = self._at()
        if not fs.exists(base):
            return []
        root = fs.getFileStatus(base).getPath().toString().rstrip("/") + "/"
        found, files = [], fs.listFiles(base, True)
        while files.hasNext():
            key = files.next().getPath().toString().removeprefix(root)
            if key.startswith(prefix) and key != prefix and not UNFINISHED.search(key):
                found.append(key)
        return sorted(found)

    def list_status(self, folder: str = "") -> DataFrame:
        """One row for each entry directly in a folder, folders too."""
        fs, path = self._at(folder)
        rows = [(s.getLen(), s.isDirectory(), 1, 4096, s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(path)]
        return self.spark.createDataFrame(rows, STATUS)

    def list_from(self, folder: str = "", recursive: bool = False) -> list[str]:
        """Files in a folder, at depth one or any."""
        fs, path = self._at(folder)
        files, found = fs.listFiles(path, recursive), []
        while files.hasNext():
            found.append(files.next().getPath().toString())
        return sorted(found)

    def scan(self, prefix: str = "", partitions: int | None = None) -> DataFrame:
        """(key, length, content) of the objects under a prefix; empty objects are left out, others fail the job if unreadable.

        Only the prefix's folder is listed. ``partitions`` deals objects by a hash of their key. Objects with a name, or in
        a folder, that Spark's sources skip are streamed to a scratch folder first, and those are read; there should be few.
        """
        folder, _, _ = prefix.rpartition("/")
        fs, path = self._at(folder)
        root = fs.getFileStatus(self._at()[1]).getPath().toUri().getPath().rstrip("/") + "/"
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path.toString())
        key = F.substr("path", F.locate(root, F.col("path")) + len(root))
        found = files.select(key.alias("key"), "length", "content").filter(F.col("key").startswith(prefix) & (F.col("key") != prefix))
        if hidden := [k for k in self.list(prefix) if any(_skipped(x) for x in k[len(folder) :].split("/") if x)]:
            copies = [(k, f"{n:09d}") for n, k in enumerate(hidden)]
            beside = scratch(self.spark)
            to_fs, to = file_system(self.spark, beside)
            for k, name in copies:
                source = self._at(k)[1]
                self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, self.spark._jvm.org.apache.hadoop.fs.Path(to, name), False, self.spark._jsc.hadoopConfiguration())
            names = self.spark.createDataFrame(copies, "key string, name string")
            more = self.spark.read.format("binaryFile").load(beside).withColumn("name", F.substring_index("path", "/", -1)).join(F.broadcast(names), "name")
            found = found.unionByName(more.select("key", "length", "content"))
        found = found.filter("length > 0")
        return found.repartition(partitions, bucket(F.col("key"), partitions)) if partitions else found


def merged_listing(*listings: DataFrame) -> DataFrame:
    """Keys of several listings, each once."""
    out = listings[0]
    for x in listings[1:]:
        out = out.union(x)
    return out.distinct()
