import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write(tmp_path):
    """Write text to a new CSV file and return its path."""

    def save(text: str, name: str = "data.csv", bom: bool = False) -> str:
        path = tmp_path / name
        path.write_text(text, encoding="utf-8-sig" if bom else "utf-8", newline="")
        return str(path)

    return save
