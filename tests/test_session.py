"""Checkpoint folder rules: the session's setting wins; a cluster without
one is refused (a machine-local folder would break on executors)."""
import pytest

from basketry.session import checkpoint_dir


class _Opt:
    def __init__(self, value=None):
        self.value = value

    def isDefined(self):
        return self.value is not None

    def get(self):
        return self.value


class _Stub:
    def __init__(self, master, current=None, conf=None):
        outer = self
        self.master = master
        self._current = _Opt(current)
        self._conf = conf or {}
        self.set_to = None

        class _Sc:
            def getCheckpointDir(self_inner):
                return outer._current

        class _Jsc:
            def sc(self_inner):
                return _Sc()

        self._jsc = _Jsc()

    def setCheckpointDir(self, d):
        self.set_to = d
        self._current = _Opt(d)


class _Session:
    def __init__(self, sc):
        self.sparkContext = sc
        self.conf = self

    def get(self, key, default=None):
        return self.sparkContext._conf.get(key, default)


def test_existing_setting_is_used():
    s = _Session(_Stub("yarn", current="hdfs://nn/ckpt"))
    assert checkpoint_dir(s) == "hdfs://nn/ckpt"


def test_conf_setting_is_applied():
    sc = _Stub("k8s://api", conf={"spark.checkpoint.dir": "s3a://bucket/ckpt"})
    assert checkpoint_dir(_Session(sc)) == "s3a://bucket/ckpt" and sc.set_to == "s3a://bucket/ckpt"


def test_cluster_without_setting_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session(_Stub("spark://master:7077")))


def test_local_session_gets_a_tmp_folder():
    sc = _Stub("local[4]")
    assert checkpoint_dir(_Session(sc)).startswith("/tmp/basketry-ckpt-")
