"""A Spark data source of text items from PDF files, where a PDF library is installed.

spark.dataSource.register(PdfItems); spark.read.format("quire_pdf").load(path). Each file is read by one task.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.operators.pages import half_up

SCHEMA = "doc_id long, page int, seq long, str string, size double, font string, x0 double, x1 double, y_base double, y_top double, y_bot double"


class PdfItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options["path"])


class PdfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        return [InputPartition((i, f.path)) for i, f in enumerate(found) if f.path.lower().endswith(".pdf")]

    def read(self, partition: InputPartition):
        try:
            import fitz  # a PDF library; not among this package's needs
        except ImportError as e:
            raise RuntimeError("reading PDF files needs PyMuPDF on the executors; spans may be read from Parquet instead") from e
        from pyarrow import fs

        number, path = partition.value
        system, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(at) as f, fitz.open(stream=f.read(), filetype="pdf") as doc:
            for page in doc:
                seq = 0
                for block in page.get_text("dict")["blocks"]:
                    for line in block.get("lines", ()):
                        for s in line["spans"]:
                            if s["text"].strip():
                                x0, _, x1, _ = s["bbox"]
                                y, size = s["origin"][1], s["size"]
                                yield (number, page.number, seq, s["text"], half_up(size, 1), s["font"].split("+")[-1], x0, x1, y, y - 0.78 * size, y + 0.24 * size)
                                seq += 1
