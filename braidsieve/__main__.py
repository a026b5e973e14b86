import sys

from braidsieve.cli import main

sys.exit(main())
