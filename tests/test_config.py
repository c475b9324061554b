import pytest

from webloom.cli import parse
from webloom.config import Settings, load_file


def test_defaults_and_clamps():
    s = Settings(workers=0, max_bytes=1, jitter=7, warc_path="x").clamped()
    assert (s.workers, s.max_bytes, s.jitter, s.warc) == (1, 1024, 1.0, True)
    assert Settings().max_pages == 100 and Settings().strip_params


def test_precedence(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('delay = 2.0\n[crawl]\nmax_pages = 7\nallow_params = ["a"]\n')
    assert load_file(str(file)) == {"delay": 2.0, "max_pages": 7, "allow_params": ["a"]}
    _, _, s = parse(["http://h/", "out", "--config", str(file), "--delay", "1", "--allow-param", "b", "--external"])
    assert (s.delay, s.max_pages, s.allow_params, s.same_origin_only, s.crawl) == (1.0, 7, frozenset("ab"), False, False)
    with pytest.raises(SystemExit):
        parse(["ftp://h/", "out"])


def test_settings_without_effect_are_refused():
    Settings().refuse_unsupported()
    for more in ({"render_js": True}, {"kv_backend": "sqlite"}, {"checkpoint_pages": 9}, {"warc_path": "x"}):
        with pytest.raises(ValueError, match=next(iter(more))):
            Settings(**more).clamped().refuse_unsupported()
