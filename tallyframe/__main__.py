import sys

from tallyframe.cli import main

sys.exit(main())
