"""python -m marginalia FOLDER TOOL [JSON]: one call of a tool on a folder of markdown."""

from __future__ import annotations

import json
import sys

from marginalia.engine import Engine
from marginalia.operators.access import InvalidArgument, NotFound
from marginalia.operators.sqlgate import SqlError, SqlTimeout
from marginalia.session import session

#: Exit codes by error.
EXIT = {InvalidArgument: 2, SqlError: 2, NotFound: 3, SqlTimeout: 4}


def main(argv: list[str]) -> int:
    if len(argv) not in (2, 3):
        print(__doc__, file=sys.stderr)
        return 2
    folder, tool, *args = argv
    try:
        print(json.dumps(Engine.open_folder(session(), folder).call(tool, json.loads(args[0]) if args else {}), ensure_ascii=False, indent=1, default=str))
        return 0
    except tuple(EXIT) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return EXIT[type(e)]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
