"""The format registry, file signatures and fence languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of text formats by MIME type and category.
TEXT_FORMATS = [
    ("txt", "text/plain", "text"), ("md", "text/markdown", "text"), ("markdown", "text/markdown", "text"), ("rst", "text/x-rst", "text"),
    ("json", "application/json", "code"), ("jsonc", "application/json", "code"), ("jsonl", "application/x-ndjson", "code"), ("xml", "application/xml", "code"),
    ("yaml", "application/yaml", "code"), ("yml", "application/yaml", "code"), ("toml", "application/toml", "code"), ("ini", "text/plain", "code"),
    ("properties", "text/plain", "code"), ("csv", "text/csv", "text"), ("tsv", "text/tab-separated-values", "text"), ("html", "text/html", "code"),
    ("htm", "text/html", "code"), ("css", "text/css", "code"), ("js", "text/javascript", "code"), ("mjs", "text/javascript", "code"),
    ("cjs", "text/javascript", "code"), ("ts", "text/typescript", "code"), ("tsx", "text/typescript", "code"), ("jsx", "text/javascript", "code"),
    ("py", "text/x-python", "code"), ("java", "text/x-java-source", "code"), ("kt", "text/x-kotlin", "code"), ("kts", "text/x-kotlin", "code"),
    ("c", "text/x-c", "code"), ("h", "text/x-c", "code"), ("cc", "text/x-c++", "code"), ("cpp", "text/x-c++", "code"), ("cxx", "text/x-c++", "code"),
    ("hpp", "text/x-c++", "code"), ("cs", "text/x-csharp", "code"), ("go", "text/x-go", "code"), ("rs", "text/x-rust", "code"), ("swift", "text/x-swift", "code"),
    ("php", "text/x-php", "code"), ("rb", "text/x-ruby", "code"), ("sh", "text/x-shellscript", "code"), ("bash", "text/x-shellscript", "code"),
    ("zsh", "text/x-shellscript", "code"), ("ps1", "text/x-powershell", "code"), ("bat", "text/x-msdos-batch", "code"), ("cmd", "text/x-msdos-batch", "code"),
    ("sql", "application/sql", "code"), ("graphql", "application/graphql", "code"), ("gql", "application/graphql", "code"), ("vue", "text/plain", "code"), ("svelte", "text/plain", "code"),
]
#: Other extensions with MIME type, category, level and adapter.
OTHER_FORMATS = [
    ("pdf", "application/pdf", "document", "A", "pdf"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document", "B", "docx"),
    ("docm", "application/vnd.ms-word.document.macroEnabled.12", "document", "B", "docx"),
    ("doc", "application/msword", "document", "D", "inventory"),
    ("rtf", "application/rtf", "document", "D", "inventory"),
    ("odt", "application/vnd.oasis.opendocument.text", "document", "D", "inventory"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "spreadsheet", "B", "spreadsheet"),
    ("xlsm", "application/vnd.ms-excel.sheet.macroEnabled.12", "spreadsheet", "B", "spreadsheet"),
    ("xls", "application/vnd.ms-excel", "spreadsheet", "D", "inventory"),
    ("ods", "application/vnd.oasis.opendocument.spreadsheet", "spreadsheet", "D", "inventory"),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "presentation", "B", "presentation"),
    ("pptm", "application/vnd.ms-powerpoint.presentation.macroEnabled.12", "presentation", "B", "presentation"),
    ("ppt", "application/vnd.ms-powerpoint", "presentation", "D", "inventory"),
    ("png", "image/png", "image", "C", "image"),
    ("jpg", "image/jpeg", "image", "C", "image"),
    ("jpeg", "image/jpeg", "image", "C", "image"),
    ("gif", "image/gif", "image", "C", "image"),
    ("webp", "image/webp", "image", "C", "image"),
    ("bmp", "image/bmp", "image", "C", "image"),
    ("tif", "image/tiff", "image", "C", "image"),
    ("tiff", "image/tiff", "image", "C", "image"),
    ("svg", "image/svg+xml", "image", "C", "image"),
    ("zip", "application/zip", "archive", "D", "inventory"),
    ("gz", "application/gzip", "archive", "D", "inventory"),
    ("tgz", "application/gzip", "archive", "D", "inventory"),
    ("rar", "application/vnd.rar", "archive", "D", "inventory"),
    ("7z", "application/x-7z-compressed", "archive", "D", "inventory"),
    ("tar", "application/x-tar", "archive", "D", "inventory"),
    ("mp3", "audio/mpeg", "audio", "D", "inventory"),
    ("wav", "audio/wav", "audio", "D", "inventory"),
    ("ogg", "audio/ogg", "audio", "D", "inventory"),
    ("m4a", "audio/mp4", "audio", "D", "inventory"),
    ("mp4", "video/mp4", "video", "D", "inventory"),
    ("mov", "video/quicktime", "video", "D", "inventory"),
    ("webm", "video/webm", "video", "D", "inventory"),
    ("sqlite", "application/vnd.sqlite3", "database", "D", "inventory"),
    ("sqlite3", "application/vnd.sqlite3", "database", "D", "inventory"),
    ("db", "application/octet-stream", "database", "D", "inventory"),
    ("exe", "application/vnd.microsoft.portable-executable", "binary", "E", "blocked"),
    ("dll", "application/vnd.microsoft.portable-executable", "binary", "E", "blocked"),
    ("msi", "application/x-msi", "binary", "E", "blocked"),
    ("app", "application/octet-stream", "binary", "E", "blocked"),
    ("dmg", "application/x-apple-diskimage", "binary", "E", "blocked"),
    ("apk", "application/vnd.android.package-archive", "binary", "E", "blocked"),
    ("jar", "application/java-archive", "binary", "E", "blocked"),
    ("wasm", "application/wasm", "binary", "E", "blocked"),
]
#: Names without extension that are text.
SPECIAL_NAMES = [
    ("dockerfile", "text/x-dockerfile", "code"), ("makefile", "text/x-makefile", "code"), ("license", "text/plain", "text"), ("readme", "text/plain", "text"),
    (".env", "text/plain", "code"), (".gitignore", "text/plain", "code"), (".npmrc", "text/plain", "code"), (".editorconfig", "text/plain", "code"),
]
MACRO, ACTIVE = ("docm", "xlsm", "pptm"), ("html", "htm", "svg")
NESTED = ("zip", "gz", "tgz", "rar", "7z", "tar")
ZIP_CONTAINERS, OLE_CONTAINERS = ("docx", "docm", "xlsx", "xlsm", "pptx", "pptm", "odt", "ods"), ("doc", "xls", "ppt")
#: First bytes in hexadecimal, with offset, MIME type, category and whether executable; the first match counts.
SIGNATURES = [
    ([(0, "255044462D")], "application/pdf", "document", False),
    ([(0, "89504E470D0A1A0A")], "image/png", "image", False),
    ([(0, "FFD8FF")], "image/jpeg", "image", False),
    ([(0, "474946383761")], "image/gif", "image", False),
    ([(0, "474946383961")], "image/gif", "image", False),
    ([(0, "52494646"), (8, "57454250")], "image/webp", "image", False),
    ([(0, "424D")], "image/bmp", "image", False),
    ([(0, "49492A00")], "image/tiff", "image", False),
    ([(0, "4D4D002A")], "image/tiff", "image", False),
    ([(0, "504B0304")], "application/zip", "archive", False),
    ([(0, "504B0506")], "application/zip", "archive", False),
    ([(0, "504B0708")], "application/zip", "archive", False),
    ([(0, "1F8B")], "application/gzip", "archive", False),
    ([(0, "377ABCAF271C")], "application/x-7z-compressed", "archive", False),
    ([(0, "526172211A07")], "application/vnd.rar", "archive", False),
    ([(0, "D0CF11E0A1B11AE1")], "application/x-ole-storage", "binary", False),
    ([(0, "53514C69746520666F726D6174203300")], "application/vnd.sqlite3", "database", False),
    ([(0, "7F454C46")], "application/x-elf", "binary", True),
    ([(0, "4D5A")], "application/vnd.microsoft.portable-executable", "binary", True),
    ([(0, "FEEDFACE")], "application/x-mach-binary", "binary", True),
    ([(0, "FEEDFACF")], "application/x-mach-binary", "binary", True),
    ([(0, "CEFAEDFE")], "application/x-mach-binary", "binary", True),
    ([(0, "CFFAEDFE")], "application/x-mach-binary", "binary", True),
    ([(0, "CAFEBABE")], "application/x-mach-binary", "binary", True),
    ([(0, "4F676753")], "application/ogg", "audio", False),
    ([(0, "494433")], "audio/mpeg", "audio", False),
    ([(0, "52494646"), (8, "57415645")], "audio/wav", "audio", False),
    ([(4, "66747970")], "video/mp4", "video", False),
    ([(0, "1A45DFA3")], "video/webm", "video", False),
    ([(0, "0061736D")], "application/wasm", "binary", True),
]
#: Languages of fenced code by extension; others are text.
LANGUAGES = {
    "bat": "bat", "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "css": "css", "csv": "csv", "dockerfile": "dockerfile", "go": "go", "h": "c", "hpp": "cpp",
    "htm": "html", "html": "html", "ini": "ini", "java": "java", "js": "javascript", "json": "json", "jsonc": "jsonc", "jsonl": "jsonl", "jsx": "jsx", "kt": "kotlin",
    "kts": "kotlin", "md": "markdown", "php": "php", "properties": "properties", "ps1": "powershell", "py": "python", "rb": "ruby", "rs": "rust", "rst": "rst",
    "sh": "shell", "sql": "sql", "swift": "swift", "toml": "toml", "ts": "typescript", "tsv": "tsv", "tsx": "tsx", "txt": "text", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}

REGISTRY_SCHEMA = "kind string, key string, mime string, category string, level string, adapter string, macro boolean, active boolean, executable boolean, nested boolean"


def registry_rows() -> list[tuple]:
    """(kind, key, mime, category, level, adapter, macro, active, executable, nested), kind being extension or name."""
    flags = lambda e: (e in MACRO, e in ACTIVE)
    rows = [("extension", e, m, c, "A", "text", *flags(e), False, False) for e, m, c in TEXT_FORMATS]
    rows += [("extension", e, m, c, lv, a, *flags(e), lv == "E", e in NESTED) for e, m, c, lv, a in OTHER_FORMATS]
    return rows + [("name", n, m, c, "A", "text", False, False, False, False) for n, m, c in SPECIAL_NAMES]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), REGISTRY_SCHEMA)


def signature_of(content: Column) -> Column:
    """struct(mime, category, executable) of the first matching signature of a binary column, or null."""

    def of_head(head: Column) -> Column:
        out = None
        for parts, mime, category, executable in SIGNATURES:
            test = None
            for at, code in parts:
                here = head.startswith(code) if at == 0 else F.substring(head, 2 * at + 1, len(code)) == code
                test = here if test is None else test & here
            found = F.struct(F.lit(mime).alias("mime"), F.lit(category).alias("category"), F.lit(executable).alias("executable"))
            out = F.when(test, found) if out is None else out.when(test, found)
        return out

    # the lambda binds the head once for all tests
    return F.get(F.transform(F.array(F.hex(F.substring(content, 1, 16))), of_head), 0)


def fence_language(name: Column, extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    special = F.lower(name).isin("dockerfile", "makefile")
    return F.when(special, F.lower(name)).otherwise(F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit("text")))
