import sys

from vatlens.cli import main

sys.exit(main())
