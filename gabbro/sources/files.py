"""Small files in any store that Spark can reach, by its Hadoop file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm  # noqa: SLF001

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def create(self, path: str, text: str) -> bool:
        """A new file that appears whole or not at all; False if there is one already. The text is written
        beside it and renamed without overwriting, which the file system decides (as Spark's own
        checkpoint files are made), so no reader sees a part and of two writers one wins."""
        p, fs = self._at(path)
        if fs.exists(p):
            return False
        beside, _ = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        how = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # noqa: SLF001
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(beside, p, how)
        except Exception as e:  # noqa: BLE001  the store's own class of error
            fs.delete(beside, False)
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        n = fs.getFileStatus(p).getLen()
        f = fs.open(p)
        try:
            reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(f, "UTF-8"))
            return "\n".join(iter(reader.readLine, None)) if n else ""
        finally:
            f.close()

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def list(self, path: str, deep: bool = False) -> list[tuple[str, int, int]]:
        """(path, bytes, modified in ms) of files below a folder."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        found, it = [], fs.listFiles(p, deep)
        while it.hasNext():
            s = it.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(found)
