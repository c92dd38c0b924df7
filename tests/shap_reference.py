"""One tree and one row at a time: what the vectorised explanation is held against."""

import numpy as np


def tree_predict(tree: dict, x: np.ndarray) -> float:
    i = 0
    while tree["left"][i] >= 0:
        i = tree["left"][i] if x[tree["feature"][i]] <= tree["threshold"][i] else tree["right"][i]
    return float(tree["value"][i])


def tree_shap(tree: dict, x: np.ndarray, phi: np.ndarray, scale: float = 1.0) -> None:
    """Add the path-dependent SHAP values of one tree for one row into ``phi``."""
    feat, thr, left, right, cover, value = (tree[k] for k in ("feature", "threshold", "left", "right", "cover", "value"))

    def extend(path, z, o, d):
        path = [list(e) for e in path]
        n = len(path)
        path.append([d, z, o, 1.0 if n == 0 else 0.0])
        for i in range(n - 1, -1, -1):
            path[i + 1][3] += o * path[i][3] * (i + 1) / (n + 1)
            path[i][3] = z * path[i][3] * (n - i) / (n + 1)
        return path

    def unwind(path, idx):
        path = [list(e) for e in path]
        depth = len(path) - 1
        o, z = path[idx][2], path[idx][1]
        nxt = path[depth][3]
        for i in range(depth - 1, -1, -1):
            if o != 0:
                t = path[i][3]
                path[i][3] = nxt * (depth + 1) / ((i + 1) * o)
                nxt = t - path[i][3] * z * (depth - i) / (depth + 1)
            else:
                path[i][3] = path[i][3] * (depth + 1) / (z * (depth - i))
        for i in range(idx, depth):
            path[i][0], path[i][1], path[i][2] = path[i + 1][0], path[i + 1][1], path[i + 1][2]
        return path[:depth]

    def unwound_sum(path, idx):
        depth = len(path) - 1
        o, z = path[idx][2], path[idx][1]
        nxt = path[depth][3]
        total = 0.0
        for i in range(depth - 1, -1, -1):
            if o != 0:
                t = nxt * (depth + 1) / ((i + 1) * o)
                total += t
                nxt = path[i][3] - t * z * (depth - i) / (depth + 1)
            else:
                total += (path[i][3] / z) / ((depth - i) / (depth + 1))
        return total

    def recurse(j, path, z, o, d):
        path = extend(path, z, o, d)
        if left[j] < 0:
            for i in range(1, len(path)):
                w = unwound_sum(path, i)
                phi[path[i][0]] += scale * w * (path[i][2] - path[i][1]) * value[j]
            return
        f = feat[j]
        hot, cold = (left[j], right[j]) if x[f] <= thr[j] else (right[j], left[j])
        iz, io = 1.0, 1.0
        k = next((i for i in range(len(path)) if path[i][0] == f), None)
        if k is not None:
            iz, io = path[k][1], path[k][2]
            path = unwind(path, k)
        recurse(hot, path, iz * cover[hot] / cover[j], io, f)
        recurse(cold, path, iz * cover[cold] / cover[j], 0.0, f)

    recurse(0, [], 1.0, 1.0, -1)
