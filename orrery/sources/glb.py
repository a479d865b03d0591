"""Triangles of binary glTF files: positions and indices of the scene's meshes, moved as their nodes say."""

from __future__ import annotations

import json
import struct

import numpy as np

# Fixed values of the format: its mark, chunk kinds, component types, and numbers of components.
_MARK, _JSON, _BIN = 0x46546C67, 0x4E4F534A, 0x004E4942
_KIND = {5121: "<u1", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTH = {"SCALAR": 1, "VEC3": 3}
_TRIANGLES = 4


def _chunks(data: bytes) -> tuple[dict, bytes]:
    mark, version, size = struct.unpack_from("<III", data) if len(data) >= 12 else (0, 0, 0)
    if mark != _MARK or version != 2 or size > len(data):
        raise ValueError("not a binary glTF file of version 2")
    at, found = 12, {}
    while at + 8 <= size:
        n, kind = struct.unpack_from("<II", data, at)
        found.setdefault(kind, data[at + 8 : at + 8 + n])
        at += 8 + n
    if _JSON not in found:
        raise ValueError("no description in the file")
    return json.loads(found[_JSON]), found.get(_BIN, b"")


def _values(scene: dict, data: bytes, accessor: int) -> np.ndarray:
    a = scene["accessors"][accessor]
    if "sparse" in a or a["componentType"] not in _KIND or a["type"] not in _WIDTH:
        raise ValueError("unsupported accessor")
    kind, wide = np.dtype(_KIND[a["componentType"]]), _WIDTH[a["type"]]
    if "bufferView" not in a:
        return np.zeros((a["count"], wide))
    view = scene["bufferViews"][a["bufferView"]]
    if "uri" in scene["buffers"][view["buffer"]]:
        raise ValueError("data outside the file")
    step = view.get("byteStride") or kind.itemsize * wide
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    if start + (a["count"] - 1) * step + kind.itemsize * wide > len(data):
        raise ValueError("the file is too short")
    return np.ndarray((a["count"], wide), kind, data, start, (step, kind.itemsize))


def _move(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
                     [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                     [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, triangles) of the default scene, or of all meshes where there is none; an error for what isn't supported."""
    scene, data = _chunks(content)
    nodes = scene.get("nodes", [])
    if "scenes" in scene:
        todo = [(n, np.eye(4)) for n in scene["scenes"][scene.get("scene", 0)].get("nodes", [])]
    else:
        todo, nodes = [(i, np.eye(4)) for i in range(len(scene.get("meshes", [])))], [{"mesh": i} for i in range(len(scene.get("meshes", [])))]
    points, corners, n, seen = [np.zeros((0, 3))], [np.zeros((0, 3), np.int64)], 0, 0
    while todo:
        at, above = todo.pop(0)
        if (seen := seen + 1) > len(nodes):
            raise ValueError("a node comes twice")
        node, here = nodes[at], above @ _move(nodes[at])
        todo += [(c, here) for c in node.get("children", [])]
        for part in scene["meshes"][node["mesh"]]["primitives"] if "mesh" in node else []:
            if part.get("mode", _TRIANGLES) != _TRIANGLES:
                continue
            xyz = _values(scene, data, part["attributes"]["POSITION"]).astype(float)
            index = _values(scene, data, part["indices"]).reshape(-1).astype(np.int64) if "indices" in part else np.arange(len(xyz))
            if len(index) % 3 or (len(index) and index.max() >= len(xyz)):
                raise ValueError("indices out of range")
            points.append(xyz @ here[:3, :3].T + here[:3, 3])
            corners.append(index.reshape(-1, 3) + n)
            n += len(xyz)
    return np.concatenate(points), np.concatenate(corners)
