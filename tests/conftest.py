import pytest

from loomgrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("2", 2)
    session.sparkContext.setLogLevel("OFF")
    # tables here are tiny: compiling stages and planning them again would take longer than running them
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    return session
