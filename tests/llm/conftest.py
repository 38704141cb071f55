import pytest

from llm_documents import documents, write_documents


@pytest.fixture(scope="session")
def edge_rows():
    return documents()


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory, edge_rows):
    return write_documents(spark, tmp_path_factory.mktemp("edge"), edge_rows)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return write_documents(spark, path, [])
