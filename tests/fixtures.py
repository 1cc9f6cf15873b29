"""Small schemas shared by the tests."""

import pyarrow as pa


def records(pairs):
    """(seconds, text) rows with the legacy schema."""
    return pa.table({"time": pa.array([s * 1000 for s, _ in pairs], pa.int64()), "message": pa.array([t for _, t in pairs], pa.string())})


def schema_a():
    return pa.table(
        {
            "time": pa.array(range(5), pa.int64()),
            "tensor": pa.array([[2, 2], [], [4, 4], [6, 6], [8, 8]], pa.list_(pa.float64())),
            "inputs": pa.array([1, 2, 3, 4, 5], pa.float32()),
            "outputs": pa.array([{"mul": 2.0, "tensor": [2.0, 2.0]}] * 5, pa.struct([("mul", pa.float32()), ("tensor", pa.list_(pa.float64()))])),
        }
    )


def schema_b():
    return pa.table(
        {
            "time": pa.array(range(5), pa.int64()),
            "inputs": pa.array(["one", "two", "three", "four", "five"]),
            "outputs": pa.array([1, 2, 3, 4, 5], pa.float32()),
            "failures": pa.array([[]] * 5, pa.list_(pa.string())),
        }
    )


def nested():
    index = pa.array(range(5), pa.int64())
    grandchild = pa.StructArray.from_arrays([index], names=["index"])
    child = pa.StructArray.from_arrays([grandchild, index], names=["grandchild", "index"])
    return pa.table({"time": index, "child": child})
