import hashlib
import random
import subprocess
import zlib

import pytest

from twinsift.cli import main
from twinsift.sources import git


def run(at, *args):
    who = ["-c", "user.name=x", "-c", "user.email=x@example.org", "-c", "commit.gpgsign=false", "-c", "init.defaultBranch=main", "-c", "protocol.file.allow=always"]
    return subprocess.run(["git", *who, *args], cwd=at, check=True, capture_output=True, text=True).stdout.strip()


def repository(at, texts, pack):
    """Two commits, a branch beside, deltas between similar files, a subfolder, a link, an empty file."""
    at.mkdir(parents=True)
    run(at, "init", "-q")
    (at / "old.py").write_text("gone = 1\n")
    for name, text in texts.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text + "# first\n")
    run(at, "add", "-A")
    run(at, "commit", "-qm", "first")
    run(at, "branch", "beside")
    (at / "old.py").unlink()
    for name, text in texts.items():
        (at / name).write_text(text)
    (at / "empty.txt").write_text("")
    (at / "link.py").symlink_to("a.py")
    run(at, "add", "-A")
    run(at, "commit", "-qm", "second")
    (at / "untracked.py").write_text("no = 1\n")
    if pack:
        run(at, "gc", "-q", "--aggressive")
        run(at, "pack-refs", "--all")
    return run(at, "rev-parse", "HEAD")


def texts(seed):
    rng = random.Random(seed)
    body = "".join(f"value_{i} = {rng.random()}\n" for i in range(600))
    return {"a.py": body, "sub/deep/b.py": body + "x = 1\n", "sub/c é.go": "package p\n" + body[:9000], "d.bin": "\x00" + body[::-1]}


@pytest.mark.parametrize("pack", [False, True])
def test_files_of_the_head(spark, tmp_path, pack):
    root = tmp_path / "repos"
    want = {}
    for name, seed in (("one", 1), ("group/two", 2)):
        head = repository(root / name, texts(seed), pack)
        for path, text in {**texts(seed), "empty.txt": ""}.items():
            want[name, path] = (head, text.encode())
    run(root, "clone", "-q", "--bare", str(root / "one"), "bare.git")
    head = run(root / "one", "rev-parse", "HEAD")
    want |= {("bare.git", p): v for (r, p), v in list(want.items()) if r == "one"}
    (root / "none").mkdir()
    run(root / "none", "init", "-q")  # no commit
    repository(root / "detached", texts(3), pack)
    first = run(root / "detached", "rev-parse", "HEAD~1")
    run(root / "detached", "checkout", "-q", "-f", first)
    want |= {("detached", p): (first, (t + "# first\n").encode()) for p, t in texts(3).items()} | {("detached", "old.py"): (first, b"gone = 1\n")}
    if pack:
        assert list((root / "one/.git/objects/pack").glob("*.pack")) and not (root / "one/.git/refs/heads/main").exists()
    found = git.from_git(spark, str(root)).collect()
    assert {(r["repository_id"], r["path"]): (r["commit_hash"], bytes(r["content"])) for r in found} == want and len(found) == len(want)
    for r in found:
        assert r["blob_id"] == hashlib.sha1(b"blob %d\0" % len(r["content"]) + r["content"]).hexdigest()
    assert {r["path"]: (r["lang"], r["is_binary"]) for r in found}["sub/c é.go"] == ("Go", False)
    assert head in {r["commit_hash"] for r in found}


def test_packs_with_deltas_by_name_and_broken_ones(spark, tmp_path):
    """A thin order of entries: deltas before their base, chains, and a cache that holds one object."""
    one, two, three = b"the first text " * 50, b"the first text " * 50 + b"and more", b"the first text " * 50 + b"and more again"

    def size(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def delta(base, new):
        rest = new[len(base) :]
        return size(len(base)) + size(len(new)) + bytes([0x80 | 0x30]) + len(base).to_bytes(2, "little") + bytes([len(rest)]) + rest

    def entry(kind, raw, base=b""):
        n, first = len(raw), kind << 4 | len(raw) & 15
        n >>= 4
        head = bytes([first | 128 * (n > 0)]) + (size(n) if n else b"")
        return head + base + zlib.compress(raw)

    name = lambda c: hashlib.sha1(b"blob %d\0" % len(c) + c).digest()
    entries = [entry(7, delta(two, three), name(two)), entry(7, delta(one, two), name(one)), entry(3, one)]
    pack = b"PACK" + (2).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"".join(entries)
    assert {(n, c) for n, _, c in git.Pack(pack)} == {(name(c).hex(), c) for c in (one, two, three)}
    assert git.patched(b"abc", size(3) + size(5) + bytes([0x91, 1, 2, 3]) + b"xyz") == b"bcxyz"
    for bad in (pack[:40], b"nothing at all here", pack.replace(name(one), name(b"?"))):
        with pytest.raises((ValueError, KeyError, IndexError, zlib.error)):
            list(git.Pack(bad))
    at = tmp_path / "r" / "objects" / "pack"
    at.mkdir(parents=True)
    (at / "pack-00.pack").write_bytes(pack)
    (at / "pack-11.pack").write_bytes(pack[:60])
    got = git.objects(spark, str(tmp_path)).collect()
    assert len([r for r in got if r["error"] is None]) == 3 and len([r for r in got if r["error"]]) == 1


def test_hashing_repositories_from_the_command_line(spark, tmp_path, capsys):
    repository(tmp_path / "in" / "one", texts(1), True)
    repository(tmp_path / "in" / "two", texts(1), False)
    store = ["--store", str(tmp_path / "store")]
    assert main(["hash", str(tmp_path / "in"), "--format", "git", *store], spark) == 0
    assert "one\n  two\n" in capsys.readouterr().out
    assert main(["report", *store], spark) == 0
    assert "(2 duplicates)" in capsys.readouterr().out
