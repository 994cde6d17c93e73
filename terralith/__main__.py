"""python -m terralith: the command line."""

import sys

from terralith.cli import main

sys.exit(main())
