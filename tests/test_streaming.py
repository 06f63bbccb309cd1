"""A log read in pieces gives what one pass gives."""

from pyspark.sql import functions as F

from stowline.functions.events import events
from stowline.operators.correlate import moves
from stowline.plans.engine import from_folder
from stowline.sources.gamelog import read_lines
from stowline.streaming.tail import follow, followed_moves
from test_log import add, at, class_move, done, line, place, spawn

COLUMNS = ["line_offset", "item_ix", "move_type", "item_class", "item_geid", "tgt_key", "result", "caller"]


def test_pieces_equal_one_pass(spark, tmp_path):
    lines = [
        place(at(0), 5001), add(at(0), 5, "hat_a", "9001:Location:5001", "INVALID", caller="X::AttachItem"), class_move(at(0), 5, "hat_a", 1, "9001:Location:5001", "INVALID", "Interaction"), spawn(at(0, 30), 5, "hat_a", 700000000002), done(at(0, 35), 5),
        class_move(at(1), 6, "ammo", 1, "9001:Location:5001", "7:Container:0"), line(at(1, 30), "Channel Disconnected", 'cause=1 reason="x"'), done(at(1, 50), 6), add(at(12), 4, "cup", "7:Container:0", "INVALID", "Drop"),
    ]
    data = ("\n".join(lines) + "\n").encode()
    logs = tmp_path / "logs"
    logs.mkdir()
    log = logs / "Game.log"
    cuts = [0, len(lines[0]) + 20, sum(len(x) + 1 for x in lines[:3]), sum(len(x) + 1 for x in lines[:6]) - 1, len(data)]
    published: list[int] = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        with log.open("ab") as f:
            f.write(data[a:z])
        follow(spark, str(logs), str(tmp_path / "out"), published.append).awaitTermination()
    # A change of place alone, in the first piece, moves nothing.
    assert 0 < len(published) < len(cuts) - 1 and 0 not in published
    whole = read_lines(spark, str(logs)).withColumn("session_id", F.lit(1))
    cold = moves(events(whole))
    live = followed_moves(spark, str(tmp_path / "out"))
    rows = lambda d: sorted((tuple(r) for r in d.select(*COLUMNS).collect()), key=str)
    assert rows(live) == rows(cold) and len(rows(cold)) == 3


def test_numbers_of_64_bits_stay_exact_beside_lines_without_one(spark, tmp_path):
    n, logs, out = 2**53 + 1, tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    ends = ("9001:Location:5001", "7:Container:0")
    lines = [place(at(0), 5001), class_move(at(0), n, "ammo", 1, *ends), class_move(at(0), n + 1, "gun", 1, *ends), done(at(0, 9), n)]
    (logs / "Game.log").write_text("\n".join(lines) + "\n")
    follow(spark, str(logs), out).awaitTermination()
    assert {(r["request_no"], r["item_class"], r["result"]) for r in followed_moves(spark, out).collect()} == {(n, "ammo", "succeed"), (n + 1, "gun", None)}


def test_a_rotated_log_goes_on_and_loses_what_no_line_answered(spark, tmp_path):
    """The live log is renamed when the next one begins: its session goes on, ends, and agrees with a batch over the folder."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    old = [class_move(at(0), 6, "ammo", 1, "9001:Location:5001", "7:Container:0"), done(at(0, 9), 6), class_move(at(1), 7, "gun", 1, "9001:Location:5001", "7:Container:0"), class_move(at(2), 8, "cup", 1, "9001:Location:5001", "7:Container:0")]
    new = [class_move(at(30), 6, "hat", 1, "9001:Location:5001", "7:Container:0")]
    log = logs / "Game.log"
    log.write_text("\n".join(old[:3]) + "\n")
    follow(spark, str(logs), out).awaitTermination()
    result = lambda d: {(r["item_class"], r["result"]) for r in d.collect()}
    assert result(followed_moves(spark, out)) == {("ammo", "succeed"), ("gun", None)}
    with log.open("a") as f:
        f.write(old[3] + "\n")
    (logs / "logbackups").mkdir()
    log.rename(logs / "logbackups" / "Game Build(12300000).log")
    log.write_text("\n".join(new) + "\n")
    for _ in range(2):
        follow(spark, str(logs), out).awaitTermination()
    live = followed_moves(spark, out)
    assert live.count() == 4
    assert result(live) == {("ammo", "succeed"), ("gun", "lost"), ("cup", "lost"), ("hat", None)} == result(from_folder(spark, str(logs))["moves"])
