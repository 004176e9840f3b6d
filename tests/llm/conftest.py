import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Names that the operators' own code gives to columns.
CLASHING = """label labelled_id id metadata index value kept_id kept_n component_id first root node draw tie rounds extra rank slice place of z at before
n taken taken_copy copy target source_size bucket key held_out lang_pred letters clean mask finer k
doc places lengths h n_words n_removed window length block start marks words chars named part own other groups fp2 chunk kind""".split()


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of texts, or of (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows):
        full = [(i, r, "en", f"src{i % 3}") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        full = [(*r, len(r[1] or ""), 7, "x", 1.5, [1], *["x"] * len(CLASHING)) for r in full]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, score double, row array<int>"
        kinds += "".join(f", {c} string" for c in CLASHING)
        return spark.createDataFrame(full, kinds)

    return make

