import json
import re
import threading
import time
import zlib

import numpy as np
import pytest

from foliomill.operators import images, vision
from foliomill.sources.package import Rejected


def picture(high=40, wide=60, dark=(slice(10, 20), slice(10, 30)), alpha=255):
    rgba = np.full((high, wide, 4), 255, np.uint8)
    rgba[..., 3] = alpha
    rgba[dark] = (10, 20, 30, 255)
    return rgba


def filtered_png(rgb, kinds):
    """A PNG whose rows have the given filters."""
    out, above = b"", np.zeros(rgb.shape[1] * 3, int)
    for y, kind in zip(range(len(rgb)), kinds):
        row = rgb[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        pick = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, pick][kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    plain = images.png(rgb)
    at = plain.index(b"IDAT")
    body = zlib.compress(out)
    return plain[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big") + plain[-12:]


def test_headers_and_limits():
    data = images.png(picture()[..., :3])
    assert images.validated(data, "a.png") == images.Header("png", 60, 40, 1)
    jpeg = b"\xff\xd8\xff\xe1\x00\x04xx\xff\xc0\x00\x11\x08\x00\x28\x00\x3c\x03" + b"\0" * 20
    assert images.validated(jpeg, "a.jpg") == images.Header("jpeg", 60, 40, 1) and b"\xff\xe1" not in images.without_metadata(jpeg)
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (59).to_bytes(3, "little") + (39).to_bytes(3, "little")
    assert images.header(webp) == images.Header("webp", 60, 40, 1)
    for content, name, code in ((data, "a.jpg", "document_type_mismatch"), (b"GIF89a", "a.gif", "corrupt_document"), (data[:16] + b"\0\0\xff\xff\0\0\0\1" + data[24:], "a.png", "limit_exceeded")):
        with pytest.raises(Rejected) as e:
            images.validated(content, name)
        assert e.value.code == code


def test_pixels_of_all_filters():
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (images.pixels(filtered_png(rgb, range(5)))[..., :3] == rgb).all()
    with pytest.raises(Rejected):
        images.pixels(images.png(rgb)[:-30])


def test_facts_and_icons():
    about = images.facts(picture())
    assert about["components"] == 1 and not about["blank"] and about["color_count"] == 2 and 0.07 < about["foreground_coverage"] < 0.1
    assert images.facts(picture(dark=(slice(0), slice(0))))["blank"]
    assert images.decorative(60, 40, about, None) and not images.decorative(60, 40, about, None, "a chart") and not images.decorative(200, 40, about, None)
    assert images.decorative(200, 40, about, 0.02) and not images.decorative(200, 40, about, 0.05) and not images.decorative(60, 40, None, None)
    white = np.full((4, 4, 4), 255, np.uint8)
    white[0, :, 3] = 0
    assert images.flattened(white)[0].max() == 0  # bright on nothing: a dark ground
    assert images.cropped(images.png(picture()[..., :3]), (0.0, 0.0, 0.5, 0.5))[16:24] == (30).to_bytes(4, "big") + (20).to_bytes(4, "big")


def test_tiles_and_their_answers():
    assert images.tile_ranges(800, 600) == [(0, 600)]
    ranges = images.tile_ranges(500, 5000)
    assert ranges[0] == (0, 2048) and ranges[-1][1] == 5000 and all(b[0] < a[1] for a, b in zip(ranges, ranges[1:]))
    with pytest.raises(Rejected):
        images.tile_ranges(10, 50_000 * 2)
    text = lambda t, box=None: {"type": "text", "text": t, "grid": None, "header_rows": None, "source_index": 0, "bbox": box}
    got = images.merged_tiles([[text("a\nb")], [text("b\nc"), text("low", [0, 0.0, 1, 0.05]), text("in", [0.2, 0.5, 0.4, 0.6])]], [(0, 100), (80, 180)], 180, vision.without_overlap)
    assert [(e["text"], e["source_index"]) for e in got] == [("a\nb", 0), ("c", 1), ("in", 2)]
    assert got[2]["bbox"] == [0.2, pytest.approx(130 / 180), 0.4, pytest.approx(140 / 180)]


def test_dispatcher_bounds_order_and_tail():
    lock, now, most, seen = threading.Lock(), 0, 0, []

    def client(image, prompt):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
            seen.append(image)
        time.sleep(0.01)
        with lock:
            now -= 1
        if image == b"1" and seen.count(b"1") < 3:
            raise TimeoutError
        if image == b"2":
            raise ValueError("broken")
        return "rubbish" if image == b"3" and "rubbish" not in prompt else '{"text": "%s"}' % image.decode()

    jobs = vision.Dispatcher(client, 3, sleep=lambda s: None).run([vision.Job(i, str(i).encode(), "p") for i in range(8)])
    assert [j.index for j in jobs] == list(range(8)) and most <= 3
    assert jobs[1].trace == ["transient", "transient", "answered"] and jobs[2].error == "vision_failed" and jobs[3].trace == ["out of form", "answered"]
    assert [j.elements[0]["text"] for j in jobs if j.elements] == ["0", "1", "3", "4", "5", "6", "7"]
    assert seen.index(b"7") < len(seen) - 1 - seen[::-1].index(b"1")  # tried again behind the others


def test_chat_client_goes_down_in_form():
    class UnsupportedParamsError(Exception):
        pass

    asked = []

    def complete(request):
        asked.append(request.get("response_format", {}).get("type"))
        if asked[-1] == "json_schema":
            raise UnsupportedParamsError("no")
        return '{"elements": []}'

    client = vision.ChatClient(complete, "m")
    data = images.png(picture()[..., :3])
    assert client(data, "p") == '{"elements": []}' and client(data, "p") and asked == ["json_schema", "json_object", "json_object"]
    assert client.request(data, "p")["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    kinds = {"RateLimitError": "transient", "AuthenticationError": "configuration", "ContentPolicyViolationError": "refused", "OddError": "failed"}
    assert {n: vision.failure_kind(type(n, (Exception,), {})()) for n in kinds} == kinds


def test_images_are_told_in_tiles():
    tall = picture(5000, 500, (slice(100, 4900, 7), slice(10, 400)))

    def client(image, prompt):
        found = re.search(r"part (\d+) of", prompt)
        part = int(found[1]) if found else 0
        return "bad" if part == 2 else json.dumps({"text": f"part {part}"})

    (elements, error), (blank, none), (table, wrong) = vision.told(client, [images.png(tall[..., :3]), images.png(picture(dark=(slice(0), slice(0)))[..., :3]), images.png(picture(40, 400)[..., :3])])
    assert [e["text"] for e in elements] == ["part 1", "part 3"] and error == "tile_failed: model_invalid_response"
    assert blank == [] and none is None and table is None and wrong == "model_invalid_response"
