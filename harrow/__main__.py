import sys

from harrow.cli import main

sys.exit(main())
